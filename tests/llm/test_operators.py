"""Each operator against a brute-force version on small tables, and on odd and empty input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import bpe, languages, leaks, licenses, lines, lm, near, quality, rules, warc
from fleetlens.llm.common import components, remainder
from fleetlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {row.doc_id: row for row in df.collect()}


@pytest.fixture(scope="module")
def documents(make, spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {row.doc_id: row.text for row in documents.collect()}


def result(spark, name, make, sf_dir=SF_DIR):
    query = next(q for q in QUERIES if q.startswith(f"{name}_"))
    return by_id(QUERIES[query](spark, sf_dir))


def test_components(make):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (None, 3)]
    found = {row.node: row.root for row in components(make(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# Quality by compression

def test_quality_held_out(make, spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")  # the smallest tables have too few bad labels to learn from
    rows = result(spark, "op1", make, sf_dir)
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [rows[i].score for i, q in labels.items() if q == 1 and rows[i].held_out]
    bad = [rows[i].score for i, q in labels.items() if q == 0 and rows[i].held_out]
    assert all(row.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, row in rows.items())
    assert all(row.predicted == (row.score >= 0.7) and 0 <= row.score <= 1 for row in rows.values())
    assert np.mean(good) > 0.8 and np.mean(good) > np.mean(bad) + 0.5


def test_quality_odd(make, odd_documents, no_documents):
    labels = make([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    model = quality.learn(odd_documents, labels)
    rows = quality.score(odd_documents, model).collect()
    assert len(rows) == 8 and all(0 <= row.score <= 1 for row in rows)
    empty = quality.learn(no_documents, labels.limit(0))
    assert quality.score(no_documents, empty).count() == 0
    assert quality.score(odd_documents, empty).filter("score = 0.5").count() == 8


# Near copies

def brute_near(texts, threshold=0.8):
    def grams(text):
        words = text.lower().split()
        k = min(5, len(words))
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()
    sets = {i: grams(t) for i, t in texts.items()}
    root, degree, ids = {i: i for i in sets}, Counter(), sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= threshold * len(sets[a] | sets[b]) - 1e-9:
                    degree[a] += 1
                    degree[b] += 1
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
    return {i: (root[i], degree[i]) for i in ids}


def test_banding_reaches_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = near.banding(threshold, 0.999)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.999


def test_near_copies(make, spark, texts):
    found = result(spark, "op2", make)
    assert {i: (row.class_id, row.n_links) for i, row in found.items()} == brute_near(texts)


def test_near_copies_in_a_large_group(make):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(200), i % 4):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    found = by_id(near.near_copies(make(rows, "doc_id long, text string")))
    expected = brute_near(dict(rows))
    assert {i: row.class_id for i, row in found.items()} == {i: root for i, (root, _) in expected.items()}
    assert all(row.n_links <= expected[i][1] for i, row in found.items())
    # Many pairs lie close to the threshold, where banding promises its recall and no more.
    assert sum(row.n_links for row in found.values()) >= near.RECALL * sum(n for _, n in expected.values())


def test_near_copies_odd(odd_documents, no_documents):
    found = by_id(near.near_copies(odd_documents))
    assert {i: (row.class_id, row.n_links) for i, row in found.items()} == {
        1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (4, 0), 5: (5, 0), 6: (3, 1)}
    assert near.near_copies(no_documents).count() == 0


# Benchmark leaks

QUESTION = ("A farmer named Anna buys 12 apples and 30 pears for 7 euros on the market while Anna sells 12 oranges "
            "to her neighbour for a very good price today")


def leak(make, text, item=QUESTION):
    docs = make([(1, f"Some words before it all begins. {text} And a few words after it.")], "doc_id long, text string")
    return leaks.leaked_passages(docs, make([(9, item)], "item_id long, text string")).collect()


def test_leak_verbatim(make):
    (row,) = leak(make, QUESTION)
    assert (row.doc_id, row.item_id, row.verbatim) == (1, 9, True)


def test_leak_with_other_values(make):
    (row,) = leak(make, QUESTION.replace("Anna", "Bertha").replace("12", "15").replace("30", "8"))
    assert not row.verbatim and row.n_slots >= 4


def test_inconsistent_slots_are_no_leak(make):
    short = "A farmer named Anna buys 12 apples while Anna sells 12 pears"
    assert len(leak(make, short.replace("12", "15").replace("Anna", "Bertha"), short)) == 1
    assert leak(make, short.replace("12", "15", 1), short) == []
    assert leak(make, short.replace("Anna", "Bertha", 1), short) == []


def test_an_altered_number_ends_a_run(make):
    item = " ".join([QUESTION, "and then counts what is left in both of the wooden boxes that stand behind the old door of the house"])
    (row,) = leak(make, item.replace("12", "15", 1), item)
    assert row.verbatim and 13 <= row.n_tokens < row.item_tokens


@pytest.mark.parametrize("item, text", [
    ("Which river flows through the old town of Vienna", None),
    ("which river flows through the old town of Vienna", "Which river flows through the old town of Vienna"),
    ("Anna has many apples and sells them on the market for seven coins", None),
    ("Anna has many apples and sells them on the market for seven coins", "Bob has many apples and sells them on the market for seven coins"),
    ("Anna has many apples and sells them on the market for seven coins", "anna has many apples and sells them on the market for seven coins"),
    ("On the market Anna Smith sells many apples and then Anna Smith buys a very old book", "On the market Bob sells many apples and then Bob buys a very old book"),
])
@pytest.mark.parametrize("before", ["We then read ", "It ends. ", "Note: "])
def test_leaks_whatever_stands_before(make, item, text, before):
    docs = make([(1, f"{before}{text or item}, and on it goes from there")], "doc_id long, text string")
    assert [row.item_id for row in leaks.leaked_passages(docs, make([(9, item)], "item_id long, text string")).collect()] == [9]


def test_another_first_word_is_no_leak(make):
    assert leak(make, "It is the very capital of Spain.", "What is the very capital of France") == []


def brute_marked(text):
    import regex
    text = regex.sub(r"(?<=\p{N})[.,:](?=\p{N})", "", text)
    spans = regex.finditer(r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*(?:[ -]\p{Lu}\p{L}*){0,2}|\p{N}+|\p{L}+", text)
    tokens = []
    for span in spans:
        word = span.group()
        if regex.match(r"\p{N}", word):
            tokens.append(("number", word))
        elif regex.match(r"\p{Lu}", word) and not regex.match(r"[\p{L}\p{N}]", text[span.start() - 1:span.start()]):
            tokens.append(("name", word.lower()))
        elif tokens and tokens[-1][0] == "number" and regex.fullmatch(leaks.UNITS, word) and text[span.start() - 1].isspace():
            tokens.append(("unit", word))
        else:
            tokens.append((word.lower(), word.lower()))
    return tokens


def brute_leak(text, item, least=13):
    """The longest consistent run of equal templates, over all distances, by loops."""
    best = 0
    for own in {item, item.lower(), re.sub("[A-Za-z]", lambda letter: letter.group().swapcase(), item, count=1)}:
        a, b = brute_marked(own), brute_marked(text)
        for distance in range(-len(a), len(b)):
            for start in range(len(a)):
                mapping, n = {}, 0
                for at in range(start, len(a)):
                    if not 0 <= at + distance < len(b) or a[at][0] != b[at + distance][0] or mapping.setdefault(a[at], b[at + distance]) != b[at + distance]:
                        break
                    n += 1
                best = max(best, n if n >= min(least, len(a)) else 0)
    return best


def test_leaks_against_loops(make):
    rng = random.Random(4)
    words = "the of a tree 12 7 km Anna Bob river green walks 30 over Clara".split()
    items = {i: " ".join(rng.choices(words, k=rng.randint(14, 22))) for i in range(6)}
    texts = {}
    for i in range(60):
        item = items[i % 6].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(item))
            item[at] = rng.choice(words)
        texts[i] = " ".join([*rng.choices(words, k=rng.randint(0, 4)), *item, *rng.choices(words, k=3)])
    found = leaks.leaked_passages(make(list(texts.items()), "doc_id long, text string"), make(list(items.items()), "item_id long, text string"))
    got = {(row.doc_id, row.item_id): row.n_tokens for row in found.collect()}
    expected = {(d, i): brute_leak(text, item) for d, text in texts.items() for i, item in items.items()}
    expected = {key: n for key, n in expected.items() if n}
    assert set(got) <= set(expected)
    assert [(texts[d], items[i], got[d, i], expected[d, i]) for d, i in got if got[d, i] != expected[d, i]] == []
    # A run without a single window that is half words is no evidence.
    assert len(got) >= 0.9 * len(expected) > 20


def test_short_item_and_unrelated_text(make):
    assert len(leak(make, "Paint five blue wooden boats.", "paint five blue wooden boats")) == 1
    assert leak(make, "Nothing of this sort stands here at all, only other words about other things.") == []


def test_leaks_match_whole_items(make, spark, texts):
    query = QUERIES["op3_template_leaks"](spark, SF_DIR).collect()
    items = {row.item_id: row.text for row in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    whole = {(d, i) for d, text in texts.items() for i, item in items.items() if item in text}
    assert whole <= {(row.doc_id, row.item_id) for row in query}


def test_leaks_odd(make, odd_documents, no_documents):
    items = make([(1, None), (None, QUESTION), (2, ""), (2, ""), (3, "same row")], "item_id long, text string")
    assert leaks.leaked_passages(odd_documents, items).count() == 0
    assert leaks.leaked_passages(no_documents, items.limit(0)).count() == 0


# Languages

def test_languages_held_out(make, spark):
    rows = result(spark, "op4", make)
    known = {row.doc_id: (row.lang, row.text) for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [i for i, row in rows.items() if row.held_out and len(known[i][1]) > 100]
    assert np.mean([rows[i].lang_pred == known[i][0] for i in held]) > 0.95


def test_mixture_of_two(make):
    rng = random.Random(2)
    english, german = "the house of my father stands on green hill and there".split(), "das haus meines vaters steht auf einem hügel und dort ist".split()
    rows = [(i, " ".join(rng.choices(own, k=80)), lang) for i, (own, lang) in enumerate([(english, "en"), (german, "de")] * 30)]
    model = languages.learn(make(rows, "doc_id long, text string, lang string"))
    (first, second), (only,) = languages.mixtures([" ".join(rng.choices(german, k=300) + rng.choices(english, k=100)), "the green hill"], model)
    assert first[0] == "de" and 0.7 < first[1] < 0.8 and second[0] == "en" and only[0] == "en"


def test_languages_odd(odd_documents, no_documents):
    model = languages.learn(odd_documents)
    rows = languages.identify(odd_documents, model).collect()
    assert len(rows) == 8
    assert all((row.lang_pred == "und") == (row.doc_id in (1, 2, 5)) for row in rows)
    none = languages.learn(no_documents)
    assert languages.identify(no_documents, none).count() == 0
    assert languages.identify(odd_documents, none).filter("lang_pred = 'und' and score = 0").count() == 8


# Licences

def test_licenses(make, spark, texts):
    found = result(spark, "op5", make)
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for i, text in texts.items():
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((at, label) for label, p in phrases.items() for at in range(len(words)) if words[at:at + len(p.split())] == p.split())
        row = found[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        assert (row.first_word, row.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))


def test_license_blocks_meet_the_threshold(make):
    rng = random.Random(3)
    template = licenses._text("own", "one two three four five six seven eight nine ten")
    rows = []
    for i in range(60):
        kept = list(template.words[:rng.randrange(5, 11)])
        filler = [f"f{rng.randrange(50)}" for _ in range(30)]
        at = rng.randrange(30)
        rows.append((i, " ".join(filler[:at] + kept + filler[at:]), len(kept)))
    docs, blocks = licenses.license_scan(make([r[:2] for r in rows], "doc_id long, text string"), [template], 0.8)
    hit = {row.doc_id for row in docs.join(blocks, "row").collect()}
    assert hit == {i for i, _, n in rows if n >= 8}


def test_licenses_odd(odd_documents, no_documents):
    docs, blocks = licenses.license_scan(odd_documents)
    assert docs.count() == 8 and blocks.count() == 0
    assert licenses.license_scan(no_documents)[0].count() == 0


# Rules

def test_rules(make, spark, texts):
    found = result(spark, "op6", make)
    for i, text in texts.items():
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k for at in range(len(words) - 2) if windows[tuple(words[at:at + 3])] > 1 for k in (at, at + 1, at + 2)}
        own = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
        row = found[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered))
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def jensen_shannon(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    return (sum(x * np.log2(x / y) for x, y in [*zip(p, m), *zip(q, m)] if x) / 2) ** 0.5


def test_rule_verdicts(make, spark, documents):
    """Histograms, language references, limits and verdicts by loops over whole texts."""
    import regex
    kinds = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lo}\p{Lt}\p{Lm}]", r"\p{N}", r"[.,;:!?'\"()-]", r"[#*$%&|<>]"]
    rows, sums = {}, {}
    for row in documents.collect():
        words = [w for w in re.split("[\x20\x09-\x0D]+", row.text) if w]
        chars = "".join(words)
        classes = [len(regex.findall(kind, chars)) for kind in kinds]
        counts = Counter(words)
        common = [counts[w] for w in rules.WORDS]
        rows[row.doc_id] = row.lang, len(words), len(chars), [*classes, len(chars) - sum(classes)], [*common, len(words) - sum(common)]
        if row.lang:
            for k in (0, 1):
                sums[row.lang, k] = np.array(rows[row.doc_id][3 + k], float) + sums.get((row.lang, k), 0)
    guards, least = (200, 100), (0.3, 0.25)
    limits = {}
    for (lang, k), ref in sums.items():
        far = sorted(jensen_shannon(r[3 + k], ref) for r in rows.values() if r[0] == lang and r[2 - k] >= guards[k])
        low, high = (far[-int(-len(far) * share // 1) - 1] for share in (0.25, 0.5))
        limits[lang, k] = max(least[k], high + 3 * (high - low))
    found = result(spark, "op6", make)
    rejected = 0
    for i, r in rows.items():
        langs = [r[0]] if (r[0], 0) in sums else {lang for lang, _ in sums}
        odd = [r[2 - k] >= guards[k] and min(jensen_shannon(r[3 + k], sums[lang, k]) / limits[lang, k] for lang in langs) > 1 for k in (0, 1)]
        assert found[i].kept == (not found[i].base_failed and not any(odd))
        rejected += any(odd) and not found[i].base_failed
    assert rejected > 10


@pytest.mark.parametrize("lang", ["en", "de", None])
@pytest.mark.parametrize("letters", ["bcdfghjklmnpqrstvwxz", "@_/\\=+~{}[]^"])
def test_planted_junk_is_rejected(make, documents, letters, lang):
    rng = random.Random(5)
    junk = " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(600))
    docs = documents.select("doc_id", "text", "lang").union(make([(-1, junk, lang)], "doc_id long, text string, lang string"))
    assert [(row.kept, row.base_failed) for row in rules.quality_rules(docs).filter("doc_id = -1").collect()] == [(False, False)]


def test_divergence(spark):
    for p, q in [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([2.0, 2.0], [5.0, 5.0])]:
        a, b = (F.array(*[F.lit(x) for x in values]) for values in (p, q))
        got = spark.range(1).select(rules.divergence(rules.shares(a), rules.shares(b))).first()[0]
        assert got == pytest.approx(jensen_shannon(p, q), abs=1e-7)


def test_rules_odd(odd_documents, no_documents):
    rows = rules.quality_rules(odd_documents).collect()
    assert len(rows) == 8 and all(not row.kept for row in rows if row.doc_id in (1, 2, 4, 5, None))
    assert rules.quality_rules(no_documents).count() == 0


# Language model

def test_language_model(make, spark, texts):
    found = result(spark, "op7", make)
    tokens = {i: [*re.sub("[A-Z]", lambda m: m.group().lower(), t).encode().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, words in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words)
    total, distinct = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        row = found[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert row.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
        assert row.score < 0 and row.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_class_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    model = lm.Model(np.arange(9), rng.normal(size=(11, 4)), rng.normal(size=(2, 4)), rng.normal(size=(10, 4)), rng.normal(size=10))
    for a in (0, 5, 10):
        logs = lm.class_logs(model, np.arange(10), [np.full(10, a), np.full(10, 3)], block=2)
        assert np.exp(logs).sum() == pytest.approx(1)


def test_training_learns_context(make):
    rows = [(i, " ".join(["red", "apple", "green", "pear"] * 50)) for i in range(40)]
    docs = make(rows, "doc_id long, text string")
    row = lm.score(docs, F.lit(True), classes=8, rounds=4).first()
    assert row.score > row.base_score / 1.3


def test_language_model_odd(odd_documents, no_documents):
    rows = lm.score(odd_documents, remainder("doc_id", 7) != 2).collect()
    assert len(rows) == 8 and all(row.n_tokens == 1 for row in rows if row.doc_id in (1, 2, 5))
    assert lm.score(no_documents, F.lit(True)).count() == 0
    assert lm.score(odd_documents, F.lit(False)).filter("n_known = 0 and train_tokens = 0").count() == 8


# Lines

def test_simhash_and_edit_distance():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randrange(1, 700)
        hashes = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        expected = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > n)
        assert int(lines.simhashes(hashes, np.array([n]))[0]) == expected
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for x, c in enumerate(a, 1):
            row = [x] + [0] * len(b) if (old := row) is None else [x, *[0] * len(b)]
            for y, d in enumerate(b, 1):
                row[y] = min(old[y] + 1, row[y - 1] + 1, old[y - 1] + (c != d))
        assert lines.edit_distance(a, b) == row[-1]


def plain_line(line):
    """Lower case, words of ASCII letters, digits and all that is not ASCII, one space between them; marks where there is no word."""
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), line))
    marks = line.encode().strip().decode()
    return " ".join(words) or (marks and "\0" + marks)


@pytest.mark.parametrize("words, edits, least", [(10, 1, 1.0), (10, 3, 0.9), (20, 4, 0.93), (50, 8, 0.95), (150, 20, 0.95)])
def test_similar_lines_agree_in_a_block(words, edits, least):
    """Letters changed anywhere, fewer than one in ten: the share of pairs that meet, by length."""
    rng, met, all_ = random.Random(5), 0, 0
    for _ in range(200):
        a = " ".join("".join(rng.choices("etaoinshrdlucm", k=rng.randrange(3, 9))) for _ in range(words))
        b = list(a)
        for _ in range(edits):
            b[rng.choice([i for i, c in enumerate(b) if c != " "])] = rng.choice("qxzj")
        two = lines.Lines([a.encode(), "".join(b).encode()])
        assert (two.chars == len(a)).all()
        if len(a) >= 40 and lines.similar(a, "".join(b), 0.9):
            first, second = two.blocks(np.arange(2)).tolist()
            met, all_ = met + bool({*first} & {*second}), all_ + 1
    assert all_ > 100 and met >= least * all_


def test_compared_form():
    texts = ["Hello, World!\n\n  --- \nfoo  bar.\n", "x", " a b ", " ", "\n", "éÀ b--c\n---", ""]
    found = lines.Lines([text.encode() for text in texts])
    expected = [(t, i, plain_line(line)) for t, text in enumerate(texts) for i, line in enumerate(text.split("\n"))]
    own = [found.data[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert list(zip(found.text_of, found.number)) == [(t, i) for t, i, _ in expected]
    assert own == [line if not line.startswith("\0") else "" for *_, line in expected]
    assert [found.node(i) is None for i in range(len(own))] == [not line for *_, line in expected]


def brute_lines(texts):
    """Lost lines by equality and edit similarity alone, every pair compared."""
    seen = [(i, at, plain_line(line)) for i in sorted(texts) for at, line in enumerate((texts[i] or "").split("\n")) if plain_line(line)]
    root = {key: key for *_, key in seen}
    long = sorted((key for key in root if len(key) >= 40), key=len)
    members = {key: [key] for key in root}
    for a, one in enumerate(long):
        for other in long[a + 1:]:
            if len(one) < 0.9 * len(other):
                break
            if root[one] != root[other] and lines.similar(one, other, 0.9):
                old, new = root[one], root[other]
                members[new] += members[old]
                for key in members.pop(old):
                    root[key] = new
    first, lost = {}, {}
    for i, at, key in seen:
        if first.setdefault(root[key], (i, at)) != (i, at):
            lost.setdefault(i, []).append(at)
    return lost


def test_short_and_unspaced_lines(make):
    rows = [(1, "one two three\n\n***\nyes"), (2, "One, two: three!\n\n***\nno"), (3, "漢字" * 20 + "\nyes"), (4, "漢字" * 20 + "\n  \n"),
            (5, "漢字" * 19 + "漢文\n#"), (6, "#\n##")]
    found = {r.doc_id: r.dropped for r in lines.line_decisions(make(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(dict(rows)) == {2: [0, 2], 3: [1], 4: [0], 5: [0], 6: [0]}


def test_lines_of_texts_under_one_id(make):
    rows = [(1, "a clean first line of text one\nshared line"), (1, "shared line\nanother clean line"), (1, "shared line\nanother clean line"), (0, "shared line")]
    docs = make(rows, "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in lines.without_lines(docs, lines.line_decisions(docs)).collect())
    assert left == [(0, "shared line"), (1, "a clean first line of text one"), (1, "another clean line"), (1, "another clean line")]


@pytest.mark.parametrize("rounds, block", [(3, 128), (1, 16), (0, 8)])
def test_large_blocks_of_unlike_groups(make, monkeypatch, rounds, block):
    """A passage shared by lines of many groups: leaders settle some, pairs of sub-blocks the rest."""
    monkeypatch.setattr(lines, "ROUNDS", rounds)
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(3)
    bases = ["".join(rng.choices("abcdefghij klm", k=120)) for _ in range(12)]
    passage = "a passage that stands in very many lines of all the groups there are in this table of texts"
    rows = [(i, f"{bases[i % 12]} {passage} {bases[i % 12][::-1]} {i:04d}") for i in range(150)]
    found = {r.doc_id: r.dropped for r in lines.line_decisions(make(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(dict(rows)) and len(found) == 138


@pytest.mark.parametrize("block", [128, 2])
def test_a_line_like_one_that_is_like_the_leader(make, monkeypatch, block):
    """All agree in one block: those at 8 edits are like the leader, those at 16 only like them, those at 60 only like each other."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefghijklm", k=100))
    rows = [(1, base)]
    for i in range(5):
        start = 16 * i
        rows += [(10 + i, base[:start] + "x" * 8 + base[start + 8:]), (20 + i, base[:start] + "x" * 16 + base[start + 16:])]
    rows += [(30 + i, base[:30] + "y" * 60 + base[90:-1] + str(i)) for i in range(3)]
    far = [(40, "z" * 50 + base[50:])]
    nodes = [(node, [7]) for node, _ in rows + far] + [(50, [8])]
    found = lines.near_lines(make(nodes, "node long, blocks array<long>"), make([(n, t.encode()) for n, t in rows + far] + [(50, base.encode())], "node long, plain binary"), 0.9)
    expected = {n: 30 if 30 <= n < 40 else 1 for n, _ in rows}
    assert not any(lines.similar(base, dict(rows)[20 + i], 0.9) for i in range(5))
    assert {r.node: r.root for r in found.collect()} == expected and found.count() == len(rows)


def test_lines(make, spark, texts):
    found = result(spark, "op8", make)
    lost = brute_lines(texts)
    assert {i: row.dropped for i, row in found.items() if row.dropped} == lost


def test_lines_in_a_large_group(make):
    base = " ".join(f"longish{i}" for i in range(120))
    rows = [(i, f"{base} tail{i}\nown words of document number {i} stand {i} {i * i}") for i in range(400)]
    docs = make(rows, "doc_id long, text string")
    lost = brute_lines(dict(rows))
    assert {row.doc_id: row.dropped for row in lines.line_decisions(docs).collect()} == lost


def test_lines_by_edit_similarity_alone(make):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(rng.choice([10, 20, 50, 120]))]
        at = rng.randrange(len(own))
        copy = [*own[:at], own[at][::-1] + "q", *own[at + 1:]]
        rows += [(i, " ".join(own)), (100 + i, " ".join(copy))]
    near = {100 + i for i in range(80) if lines.similar(rows[2 * i][1], rows[2 * i + 1][1], 0.9)}
    assert len(near) > 60
    found = {row.doc_id: (row.dropped, row.kept_in) for row in lines.line_decisions(make(rows, "doc_id long, text string")).collect()}
    assert found.keys() <= near and len(found) >= 0.98 * len(near)
    assert all(found[i] == ([0], [i - 100]) for i in found)


def test_lines_odd(odd_documents, no_documents):
    decisions = lines.line_decisions(odd_documents)
    assert {row.doc_id: row.dropped for row in decisions.collect()} == {6: [0]}
    kept = lines.without_lines(odd_documents, decisions)
    assert kept.columns == odd_documents.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4", "5", "None"]
    assert lines.line_decisions(no_documents).count() == 0


# Tokens

def digests(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_tokens(make, spark, texts):
    tokenizer = Tokenizer.from_file(VOCAB)
    for i, row in result(spark, "op9", make).items():
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == digests(ids, tokenizer.decode(ids, skip_special_tokens=False))


def test_tokens_of_any_characters(make):
    rng = random.Random(6)
    alphabet = ["a", "B", "é", "ß", "日本", "́", "🙂", " ", "  ", "\n", "\t", "\x85", " ", " ", "'s", "'LL", "7", "½", "٣", "!",
                "<|endoftext|>", "<|endof", "\x1c", "\x00", "‍", "x" * 70, "᠎"]
    values = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)] + ["a" * 5000, "!?" * 3000, " " * 999]
    tokenizer, vocab = Tokenizer.from_file(VOCAB), bpe.vocabulary(VOCAB)
    lexicon = bpe.Lexicon(bpe.compile_lexicon(dict(zip(words := [b"a", b" the", b"aa", b"", b"xx"], vocab.merge(words)))))
    for text, ids in zip(values, bpe.encode_texts(values, vocab, lexicon), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 7))).encode() for _ in range(400)})
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: [i, i + 1] for i, w in enumerate(words)}))
    found = lexicon.find([*words, b"zz", b"", b"abcdabcda"])
    assert found.tolist() == [*range(len(words)), -1, -1, -1]
    assert all(lexicon.ids[lexicon.offsets[i]:lexicon.offsets[i + 1]].tolist() == [i, i + 1] for i in range(len(words)))
    endings = {}
    for prefix in {w[:k] for w in words for k in range(len(w) + 1)}:
        endings[prefix] = frozenset(w[len(prefix):] for w in words if w.startswith(prefix))
    assert len(lexicon.final) == len(set(endings.values()))


def test_tokens_odd(odd_documents, no_documents):
    lexicon = bpe.build_lexicon(odd_documents, VOCAB)
    rows = bpe.decode(bpe.encode(odd_documents, VOCAB, lexicon), VOCAB).collect()
    assert Counter(row.text for row in rows) == Counter(row.text or "" for row in odd_documents.collect())
    assert bpe.encode(no_documents, VOCAB, bpe.build_lexicon(no_documents, VOCAB)).count() == 0


# Archives

def archive(pages, folder):
    index = warc.normalise(warc.write(pages, f"{folder}/whole"), f"{folder}/members")
    return index, warc.read(index, f"{folder}/members")


def test_archives(make, spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    index, back = archive(pages, tmp_path)
    expected = {row.page_id: (row.url, row.html.encode()) for row in pages.collect()}
    rows = back.collect()
    assert {row.page_id: (row.url, bytes(row.payload)) for row in rows if row.payload is not None}.items() <= expected.items()
    assert len(rows) == len(expected) == index.count()


def test_archives_odd(make, tmp_path):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (2, "http://b/\r\nx: y", "same"), (3, "http://c/", None), (4, "http://d/", ""),
            (None, "http://e/", "same"), (5, "http://f/", "x\r\n\r\ny" * 9999)]
    pages = make(rows, "page_id long, url string, html string")
    _, back = archive(pages, tmp_path)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in back.collect())
    assert got == [("1", "revisit", 2, 4), ("2", "response", None, 4), ("2", "response", None, 4), ("3", "revisit", 4, 0),
                   ("4", "response", None, 0), ("5", "response", None, 59994), ("None", "response", None, 4)]
    assert archive(pages.limit(0), tmp_path / "none")[1].count() == 0


def test_index_and_sidecar_agree(make, tmp_path):
    import zlib as z
    index, _ = archive(make([(i, f"http://{i}/", f"page {i}") for i in range(50)], "page_id long, url string, html string"), tmp_path)
    places = {}
    for row in index.collect():
        places.setdefault(row.path, []).append((row.offset, row.length))
    for path, own in places.items():
        with open(f"{path}.idx") as side, open(path, "rb") as file:
            assert sorted(tuple(map(int, line.split())) for line in side) == sorted(own)
            for offset, length in own:
                file.seek(offset)
                assert z.decompress(file.read(length), 31).startswith(b"WARC/1.1\r\n")
