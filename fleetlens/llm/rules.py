"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms describe a text: classes of characters, and shares of common
words. Each is compared with the histogram of a whole language by the
Jensen-Shannon distance (base 2, so 0 to 1). The language histograms are sums
over all documents of that language; a document without a language is compared
with every language and judged by the nearest. How far is too far is measured,
too: quantiles of the distances that a language's own documents have. Short
texts say little about a distribution, so a guard on their length leaves them
to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import land

# Frequent function words by language code; the reference shares are counted, not fixed.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "una", "su"],
}
WORDS = sorted({word for words in COMMON_WORDS.values() for word in words})

# Classes of characters but white space; the first also counts the plain letters, all others are the last bin.
CHAR_CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{Lo}\\p{Lt}\\p{Lm}", "\\p{N}", ".,;:!?'\"()-", "#*$%&|<>"]

SPACE = "[\\x20\\x09-\\x0D]+"
PLAIN = "[a-z\u00df-\u00f6\u00f8-\u00ff\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` belong to a class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _without_empty(words: Column) -> Column:
    return F.array_remove(words, "")


def features(docs: DataFrame) -> DataFrame:
    """Counts of each text that the rules look at; one row per document, in one pass without a shuffle.

    ``n_repeat_words`` counts the words covered by three-word windows that
    occur at least twice in the text. Windows are compared by 64-bit hashes:
    sorted by (hash, place), equal ones stand side by side.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    split = base.select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    # Most of a text is plain letters and spaces; what is left without them is short and cheap to classify.
    counted = split.select(
        "doc_id", "lang", "text_hash", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_replace("text", PLAIN, "").alias("marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("words", lambda word: word.isin(WORDS)).alias("common"))
    window_hashes = F.transform(
        "words", lambda word, i: F.xxhash64(word, F.get("words", i + 1), F.get("words", i + 2)))
    windows = F.when(F.size("words") >= 3, F.sort_array(F.slice(
        F.arrays_zip(window_hashes.alias("h"), F.sequence(F.lit(0), F.size("words") - 1).alias("at")), 1, F.size("words") - 2)))
    counts = F.array(*[F.size("common") - F.size(F.array_remove("common", word)) for word in WORDS])
    plain = (F.col("word_chars") - F.length("marks")).cast("int")
    kept = ["doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "classes"]
    found = counted.select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars",
        F.length(F.regexp_replace("marks", SYMBOLS, "")).cast("long").alias("n_symbols"), "n_dup_lines",
        F.array(plain + _count_of(F.col("marks"), CHAR_CLASSES[0]), *[_count_of(F.col("marks"), chars) for chars in CHAR_CLASSES[1:]]).alias("classes"),
        counts.alias("shares"), windows.alias("sorted"))
    # A window repeats if its neighbour in the sorted row has the same hash.
    repeats = F.filter(F.zip_with(
        "sorted", F.slice("sorted", 2, F.size("sorted")),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"]))), lambda pair: pair.isNotNull())
    paired = found.select(*kept, "shares", repeats.alias("repeats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.flatten("repeats"), lambda at: F.array(at, at + 1, at + 2)))))
    return paired.select(
        *kept[:-1], F.when(F.size("repeats") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        _with_rest("classes", "word_chars"), _with_rest("shares", "n_words"))


def _with_rest(counts: str, total: str) -> Column:
    """Counts as doubles, with one more bin for all that is in none of them."""
    known = F.aggregate(F.col(counts), F.lit(0).cast("long"), lambda a, b: a + b)
    bins = F.concat(F.transform(counts, lambda n: n.cast("double")), F.array((F.col(total) - known).cast("double")))
    return bins.alias(counts)


def references(measured: DataFrame) -> DataFrame:
    """Histogram sums per language over all documents that have one; as many rows as languages."""
    def sums(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])
    return measured.filter("lang is not null").groupBy("lang").agg(
        sums("classes", len(CHAR_CLASSES) + 1).alias("classes"), sums("shares", len(WORDS) + 1).alias("shares"))


def shares(counts: Column) -> Column:
    """A histogram as shares; NULL if it is empty."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda n, all_: n / all_))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as shares: 0 where they are alike, 1 where disjoint."""
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2))


def _of_language(known: DataFrame) -> Column:
    """All rows of a table with one row per language, as one array: bounded by the number of languages."""
    return known.agg(F.collect_list(F.struct(*known.columns))).scalar()


def limits(measured: DataFrame, known: DataFrame, guard_chars: int, guard_words: int, spread: float, least_class: float, least_word: float) -> DataFrame:
    """``known`` with ``class_limit`` and ``word_limit``, from the distances of all documents of a language that are long enough.

    The limit is the median and ``spread`` times the way to it from the first
    quartile, as junk lies far and widens the upper half only; at least the
    smallest limits given, also where no document is long enough.
    """
    own = measured.filter("lang is not null").withColumn("refs", _of_language(known)).withColumn(
        "ref", F.get(F.filter("refs", lambda ref: ref["lang"] == F.col("lang")), F.lit(0)))
    far = own.select("lang", F.when(F.col("word_chars") >= guard_chars, divergence(shares(F.col("classes")), F.col("ref.classes"))).alias("class"),
                     F.when(F.col("n_words") >= guard_words, divergence(shares(F.col("shares")), F.col("ref.shares"))).alias("word"))
    quarters = far.groupBy("lang").agg(*[F.percentile_approx(name, [0.25, 0.5], 1000).alias(name) for name in ("class", "word")])

    def limit(name: str, least: float) -> Column:
        low, high = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        return F.greatest(F.coalesce(high + spread * (high - low), F.lit(least)), F.lit(least))
    found = quarters.select(F.col("lang").alias("of"), limit("class", least_class).alias("class_limit"), limit("word", least_word).alias("word_limit"))
    return known.join(found, F.col("lang") == F.col("of")).drop("of")


def _nearest(counts: str, limit: str) -> Column:
    """(excess, distance) of the language whose limit is least exceeded; an excess over 1 is too far."""
    def measure(ref: Column) -> Column:
        far = divergence(F.col(counts), ref[counts])
        return F.struct((far / ref[limit]).alias("excess"), far.alias("distance"))
    return F.array_min(F.filter(F.transform("refs", measure), lambda found: found["distance"].isNotNull()))


def quality_rules(docs: DataFrame, **limits: float) -> DataFrame:
    """Judge every document of (doc_id, text, lang); ``limits`` are those of ``judge``.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` per cent of them in repeated three-word windows.
    ``kept`` is false for those, and for texts whose character classes (from
    ``guard_chars`` characters on) or common words (from ``guard_words`` words
    on) lie further from their language than its ``limits``.

    NULL and empty texts have no words and fail. A NULL or unheard-of language
    means the nearest one; where no document has a language, only the base
    rules decide. A language's documents are its reference however few they
    are, so one document alone is never far from its language. Repeated rows give repeated rows. Other columns are ignored.
    """
    return judge(docs, **limits).drop("text_hash")


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, guard_chars: int = 200, guard_words: int = 100,
          spread: float = 3.0, least_class: float = 0.3, least_word: float = 0.25) -> DataFrame:
    """As ``quality_rules``, with ``text_hash`` to tell texts under one id apart.

    ``least_class`` leaves room for the long number or key in a short clean
    text; a text of ``guard_words`` words that has its language's common words
    in their usual shares stays below ``least_word`` by far.
    """
    measured = land(features(docs), "rules-features")
    known = land(references(measured).select("lang", shares(F.col("classes")).alias("classes"), shares(F.col("shares")).alias("shares")), "rules-languages")
    known = land(limits(measured, known, guard_chars, guard_words, spread, least_class, least_word), "rules-limits")
    rows = measured.withColumns({"refs": _of_language(known), "classes": shares(F.col("classes")), "shares": shares(F.col("shares"))})
    own = F.filter("refs", lambda ref: ref["lang"] == F.col("lang"))
    rows = rows.withColumn("own", own).withColumn("refs", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("refs")))
    rows = rows.withColumn("class", _nearest("classes", "class_limit")).withColumn("word", _nearest("shares", "word_limit"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    odd_classes = (F.col("word_chars") >= guard_chars) & (F.col("class.excess") > 1)
    odd_words = (F.col("n_words") >= guard_words) & (F.col("word.excess") > 1)
    return rows.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))).alias("kept"),
        F.col("class.distance").alias("class_distance"), F.col("word.distance").alias("word_distance"),
        F.col("class.excess").alias("class_excess"), F.col("word.excess").alias("word_excess"))
