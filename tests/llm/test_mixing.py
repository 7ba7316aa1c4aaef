"""Mixing: targets against water filling by loops, rounding against what it promises."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from fleetlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Sources take turns at the weights; what is above a limit is shared anew among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        wanted = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = [s for s in free if wanted[s] > most * sizes[s]]
        if not over:
            return fixed | wanted
        fixed |= {s: most * sizes[s] for s in over}


def documents(n=600):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else [None, "", "b", "\U0001f600", "￮", "a", "small"][i % 7]
        words = 1 + (i * 7919) % 90 if i % 50 else 3000
        rows.append((i, " ".join(["w"] * words), source, 1, "x"))
    return rows + [(9000, None, "a", 1, "x"), (9001, " \t\n", "b", 1, "x"), (9002, "", None, 1, "x")]


def by_source(rows):
    found = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        at = found[r.source]
        at[0] += r.size
        at[1] += r.taken
        at[2] = r.target
    return found


@pytest.mark.parametrize("group, held", [(256, 32), (8, 3), (4, 0)])
def test_mix(make, group, held):
    rows = documents()
    mixed = mixing.mix(make(rows, SCHEMA), group=group, held=held).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in mixed) == Counter((i, len((t or "").split()), s) for i, t, s, *_ in rows)
    found = by_source(mixed)
    expected = targets({source: at[0] for source, at in found.items()})
    for source, (size, taken, target) in found.items():
        assert target == pytest.approx(expected[source]) and size == next(r.source_size for r in mixed if r.source == source)
        # Within half a document; with change enough, within half a small one.
        assert abs(taken - target) <= (60 if held == 32 else 3000) / 2 + 1
    for r in mixed:
        ratio = r.target / r.source_size
        assert r.copies in (int(ratio), int(ratio) + 1) and r.taken == r.copies * r.size <= 2 * r.size


def test_reruns_agree(make):
    rows = documents()
    one, two = (sorted(map(tuple, mixing.mix(make(rows, SCHEMA).repartition(n)).collect()), key=str) for n in (2, 7))
    assert one == two


@pytest.mark.parametrize("group, held", [(256, 32), (6, 2)])
def test_expectations(make, group, held):
    """Every document is taken as often on average as its target says, large and small ones alike: forty sources of each weight."""
    rows = [(50 * source + i, "w " * [1, 3, 10, 40, 90][i % 5], f"{source:03}", 1, "x") for source in range(120) for i in range(50)]
    taken, many = Counter(), Counter()
    for r in mixing.mix(make(rows, SCHEMA), group=group, held=held).collect():
        key = r.size, round(r.target / r.source_size, 9)
        taken[key] += r.copies
        many[key] += 1
    assert len({ratio for _, ratio in many}) == 3
    for (size, ratio), copies in taken.items():
        n = many[size, ratio]
        assert abs(copies - n * ratio) <= 4.5 * (n * (ratio % 1) * (1 - ratio % 1)) ** 0.5 + 1e-6, (size, ratio)


def test_one_id_on_many_rows(make):
    """A repeated id is one unit with a count: its rows take part of the copies, exactly as many as their mass says."""
    rows = [(None, "five words are in here", "a", 1, "x")] * 700 + [(7, "two words", "a", 1, "x")] * 500 + [(i, "w " * 30, "b", 1, "x") for i in range(90)]
    mixed = mixing.mix(make(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.size) for r in mixed)[None, 5] == 700
    for size, taken, target in by_source(mixed).values():
        assert abs(taken - target) <= 30
    copies = sum(r.copies for r in mixed if r.doc_id is None)
    ratio = next(r.target / r.source_size for r in mixed if r.source == "a")
    assert int(700 * ratio) <= copies <= int(700 * ratio) + 1


def test_odd_tables(make, odd_documents, no_documents):
    assert mixing.mix(no_documents).collect() == []
    mixed = mixing.mix(odd_documents).collect()
    assert len(mixed) == odd_documents.count() and sum(r.taken for r in mixed) > 0
    empty = mixing.mix(make([(1, "", "a", 1, "x"), (2, None, None, 1, "x")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    long_one = mixing.mix(make([(1, "w " * 1_500_000, "a", 1, "x"), (2, "w", "b", 1, "x")], SCHEMA)).collect()
    assert {r.doc_id: r.size for r in long_one} == {1: 1_500_000, 2: 1}


def test_more_than_all_can_give(make):
    mixed = mixing.mix(make([(i, "w " * 10, "a", 1, "x") for i in range(20)], SCHEMA), share=3.0).collect()
    assert all(r.copies == 2 for r in mixed)
