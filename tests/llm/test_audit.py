"""The filter audit against a replay of every order."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from fleetlens.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string, source string"


def failed(text: str, copied: bool) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    checks = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
              bool(re.search(r"[#$%&*|]", text)), copied]
    return "".join(letter for letter, fails in zip("ABCDE", checks) if fails)


def replay(docs, labels):
    said = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic, *_ in labels:
        if doc_id is not None:
            said[doc_id][0] |= quality == 1
            said[doc_id][1] |= toxic == 1
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        copied = doc_id is not None and any((t or "") == (text or "") and i is not None and i < doc_id for i, t, _ in docs)
        parts[source or ""].append((failed(text or "", copied), *(said[doc_id] if doc_id is not None else (False, False))))
    rows = {}
    for part, members in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                gone = [m for m in members if set(m[0]) & set(order[:step - 1])]
                here = [m for m in members if letter in m[0] and m not in gone]
                removed_by[letter] += len(here)
                rows[part, "".join(order), step] = [
                    len(members) - len(gone) - len(here), len(here), sum(letter in m[0] for m in gone), sum(m[0] == letter for m in members),
                    sum(m[1] for m in here), sum(m[2] for m in here)]
        for (at, order, step), row in rows.items():
            if at == part:
                row.append(removed_by[order[step - 1]])
    return rows


def found(docs, labels):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed_documents, r.redundant, r.unique_fails, r.removed_good, r.removed_toxic, r.shapley]
            for r in audit.filter_audit(docs, labels).collect()}


def test_intervals_are_the_replayed_removals():
    orders = list(permutations(range(5)))
    for mask in range(32):
        spread = {}
        for step, begin, end in audit.removal_intervals(mask, 5):
            spread |= dict.fromkeys(range(begin, end), step)
        for rank, order in enumerate(orders):
            first = next((i for i, letter in enumerate(order, 1) if mask >> letter & 1), None)
            assert spread.get(rank) == first


def test_audit(make):
    plain = " ".join(f"word{i}" for i in range(60))
    loud = " ".join(f"WORD{i}" for i in range(60))
    texts = [plain, plain + " #", loud, "word " * 60, "few words", loud + " $ " + "A " * 90, None, "", "x" * 300, "éè " * 70, plain + "\u0085more one"]
    docs = [(i, texts[i % len(texts)], [None, "", "a", "b", "a"][i % 5]) for i in range(80)]
    docs += [(3, texts[3], "a"), (3, plain, "a"), (None, plain, None), (None, plain, "b"), (200, plain, None)]
    labels = [(i, i % 2, int(i % 7 == 0), "clash", "clash") for i in range(0, 60)] + [(4, 1, None, None, None), (None, 1, 1, None, None), (4, None, 1, None, None)]
    wide = make([(*row, 1, "x") for row in docs], "doc_id long, text string, source string, mask int, part string")
    expected = replay(docs, labels)
    assert found(wide, make(labels, LABELS)) == expected and len(expected) == 3 * 600


def test_audit_of_a_hot_text(make):
    docs = [(i, "the same text", "hot") for i in range(3000)] + [(5000 + i, f"other {i}", "cold") for i in range(10)]
    rows = found(make(docs, "doc_id long, text string, source string"), make([], LABELS))
    assert rows["hot", "EABCD", 1][:4] == [1, 2999, 0, 0] and rows["hot", "ABCDE", 5][1:3] == [0, 2999] and rows["hot", "ABCDE", 1][0] == 0


def test_audit_of_nothing_and_of_a_long_text(make, no_documents, odd_documents):
    assert found(no_documents, make([], LABELS)) == {}
    long_one = make([(1, "Wide " * 900_000, "s")], "doc_id long, text string, source string")
    assert found(long_one, make([], LABELS))["s", "BACDE", 1][:2] == [0, 1]
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    assert found(odd_documents, make([], LABELS)) == replay(rows, [])


@pytest.mark.parametrize("mask", [0, 5, 31])
def test_interval_ends_stay_inside(mask):
    assert all(0 <= a < b <= 120 for _, a, b in audit.removal_intervals(mask, 5))
