"""Benchmark decontamination by template windows, with DataFrame functions only.

Text becomes tokens, and numbers, names and units become typed placeholders, so
a question with other numbers or names has the same template. Windows of eight
template tokens are hashed and joined with those of the benchmark. An item and
a document that share enough windows at one distance are compared token by
token: a passage is a run of tokens with one template whose slot values map
consistently, equal values to equal values. A contradiction ends a run and
begins another, so one altered number does not hide a long copy.

Every capitalised word is a name, also the first of a sentence, so its form
does not depend on what stands before the passage; up to three names in a row
are one slot. Items are looked for in three forms: as they are, in lower case,
and with the other case of their first letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import land, small

NUMBER, NAME, UNIT, JOIN = "\u0001", "\u0002", "\u0003", "\u0004"
MARKS = f"[{NUMBER}{NAME}{UNIT}]"
# Units that may follow a number.
UNITS = ("km|cm|mm|m|kg|g|mg|t|lb|lbs|oz|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|"
         "miles?|feet|foot|inch|inches|grams?|litres?|liters?|dollars?|euros?|cents?|percent|degrees?")
WINDOW = 8
SHORT_WINDOW = 4
MIN_TOKENS = 13
# Up to so many benchmark windows are broadcast; more of them are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def marked(text: Column) -> Column:
    """Lower-case text of words and spaces; numbers, names and units begin with their mark."""
    text = F.regexp_replace(text, "[.,:](?=\\p{N})(?<=\\p{N}.)", "")
    text = F.regexp_replace(text, "\\p{Lu}(?<![\\p{L}\\p{N}].)", f"{NAME}$0")
    text = F.regexp_replace(text, f"({NAME}\\p{{L}}+)[ -]{NAME}(\\p{{L}}+)(?:[ -]{NAME}(\\p{{L}}+))?", f"$1{JOIN}$2{JOIN}$3")
    text = F.regexp_replace(text, "\\p{N}+", f" {NUMBER}$0 ")
    text = F.regexp_replace(text, f"({NUMBER}\\p{{N}}+\\s+)({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}$2")
    return F.trim(F.lower(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}{NUMBER}{NAME}{UNIT}{JOIN}]+", " ")))


def template(words: Column) -> Column:
    """Tokens of a marked text with bare marks in place of values."""
    return F.split(F.regexp_replace(words, f"({MARKS})[^ ]*", "$1"), " ")


def _longer(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long: each combined with the one ``step`` places on."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def windows(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """Rows (keep..., at, hash) of every full window of ``words``, of each of ``sizes`` (powers of two, the longest first)."""
    step, rows = 1, rows.select(*keep, template(F.col("words")).alias("tokens")).select(
        *keep, F.size("tokens").alias("n"), F.transform("tokens", lambda token: F.xxhash64(token)).alias("hashes"))
    done = []
    while step < sizes[0]:
        if step in sizes:
            rows, done = rows.withColumn(f"of_{step}", F.col("hashes")), [f"of_{step}", *done]
        rows = rows.select(*keep, "n", *done, _longer("hashes", step).alias("hashes"))
        step *= 2
    places = [F.greatest(F.col("n") - (size - 1), F.lit(0)) for size in sizes]
    full = [F.slice(name, 1, n) for name, n in zip(["hashes", *done], places, strict=True)]
    if len(sizes) == 1:
        return rows.filter(F.col("n") >= sizes[0]).select(*keep, F.posexplode(full[0]).alias("at", "hash"))
    # One list for all sizes: the places of the longest come first.
    found = rows.filter(F.col("n") >= sizes[-1]).select(*keep, places[0].alias("longest"), F.posexplode(F.concat(*full)).alias("at", "hash"))
    return found.withColumn("at", F.when(F.col("at") < F.col("longest"), F.col("at")).otherwise(F.col("at") - F.col("longest"))).drop("longest")


def _forms(text: Column) -> Column:
    """An item as it is, in lower case, and with the other case of its first letter."""
    head, first, rest = (F.regexp_extract(text, "(?s)^(\\P{L}*)(\\p{L}?)(.*)$", group) for group in (1, 2, 3))
    other = F.concat(head, F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), rest)
    return F.array(text, F.lower(text), other)


def leaked_passages(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Rows (doc_id, item_id, n_tokens, item_tokens, n_slots, verbatim): passages of items found in documents.

    A passage is a run of at least ``min_tokens`` tokens of an item, or all of
    a shorter item of four tokens and more; shorter items are no evidence. The
    first name of a shorter item has to agree, as any sentence may begin with
    another word. At least half of some window in it are words, not
    placeholders. A word put in or left out ends a run. ``verbatim`` tells that
    all slot values agree; otherwise they were replaced one by one. NULL or
    empty texts hold nothing, NULL ids cannot be named and are left out;
    repeated rows are found once; other columns are ignored.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items = named.filter("item_id is not null").select("item_id", F.explode(_forms(F.col("text"))).alias("text")).select("item_id", marked(F.col("text")).alias("words"))
    items = land(items.filter("words <> ''").distinct().select(
        "item_id", F.xxhash64("words").alias("form"), "words", F.size(F.split("words", " ")).cast("long").alias("item_tokens")), "leaks-items")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    asked = land(_candidates(texts.select("doc_id", marked(F.col("text")).alias("words")), items, min_tokens), "leaks-candidates")
    # Only documents that share enough windows with an item are marked again, for their tokens: the join comes first.
    again = texts.join(small(asked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", marked(F.col("text")).alias("words"))
    own = asked.join(items.withColumnRenamed("words", "own").drop("item_tokens"), ["item_id", "form"])
    pairs = land(again, "leaks-again").join(own, "doc_id")
    runs = _longest_run(pairs, min_tokens).filter(F.col("n_tokens") >= F.least(F.lit(min_tokens), F.col("item_tokens")))
    return runs.groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").cast("long").alias("n_tokens"), F.max("item_tokens").alias("item_tokens"),
        F.max("n_slots").cast("long").alias("n_slots"), F.max("verbatim").alias("verbatim"))


def _candidates(texts: DataFrame, items: DataFrame, min_tokens: int) -> DataFrame:
    """Rows (doc_id, item_id, form, item_tokens, distance) that share as many windows as a passage has."""
    short = F.col("item_tokens") < WINDOW
    sizes = [WINDOW] if items.filter(short & (F.col("item_tokens") >= SHORT_WINDOW)).isEmpty() else [WINDOW, SHORT_WINDOW]

    def of(size: int) -> DataFrame:
        own = items.filter(~short if size == WINDOW else short)
        words = F.expr(f"size(filter(slice(tokens, at + 1, {size}), token -> not token rlike '^{MARKS}'))")
        return windows(own, ["item_id", "form", "item_tokens", "words"], [size]).withColumn("tokens", template(F.col("words"))).select(
            "hash", "item_id", "form", "item_tokens", F.col("at").alias("item_at"), F.lit(size).alias("size"), (words >= size // 2).alias("wordy"))
    wanted = land(of(WINDOW) if len(sizes) == 1 else of(WINDOW).union(of(SHORT_WINDOW)), "leaks-windows")
    # Windows of placeholders are not looked for; where an item has such, one other window makes a candidate.
    rich = wanted.filter("not wordy").select("item_id", "form").distinct().withColumn("rich", F.lit(True))
    wanted = wanted.filter("wordy").drop("wordy").join(rich, ["item_id", "form"], "left")
    wanted = land(wanted, "leaks-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WINDOWS else wanted
    found = windows(texts, ["doc_id"], sizes).join(wanted, "hash")
    passages = found.groupBy("doc_id", "item_id", "form", "item_tokens", "size", "rich", (F.col("at") - F.col("item_at")).alias("distance")).agg(
        F.size(F.collect_set("item_at")).alias("windows"))
    needed = F.when(F.col("rich"), 1).otherwise(F.least(F.lit(min_tokens), F.col("item_tokens")) - (F.col("size") - 1))
    return passages.filter(F.col("windows") >= needed).select("doc_id", "item_id", "form", "item_tokens", "distance").distinct()


def _longest_run(pairs: DataFrame, min_tokens: int) -> DataFrame:
    """Compare ``own`` with the tokens of ``words`` that stand ``distance`` on: the longest consistent run of each pair."""
    # The document's tokens are cut out before the lambda: what a lambda refers to is computed again for each of its tokens.
    before = F.least(F.greatest(-F.col("distance"), F.lit(0)).cast("int"), F.size("own"))
    beside = F.concat(F.array_repeat(F.lit(None).cast("string"), before), F.slice(
        F.split("words", " "), F.greatest(F.col("distance"), F.lit(0)).cast("int") + 1, F.greatest(F.size("own") - before, F.lit(0))))
    pairs = pairs.withColumn("own", F.split("own", " "))
    pairs = pairs.withColumn("tokens", F.zip_with("own", beside, lambda own, theirs: F.struct(own.alias("own"), theirs.alias("theirs"))))
    pairs = pairs.withColumn("tokens", F.transform("tokens", lambda token, at: F.struct(
        at.alias("at"), token["own"].alias("own"), token["theirs"].alias("theirs")))).drop("words", "own")
    pairs = pairs.withColumn("slots", F.filter("tokens", lambda token: token["own"].rlike(f"^{MARKS}")))

    def agree(token: Column) -> Column:
        mark = F.substring(token["own"], 1, 1)
        same = token["own"].eqNullSafe(token["theirs"])
        first = (F.col("item_tokens") < min_tokens) & (token["at"] == 0) & (mark == NAME)
        slot = F.coalesce(mark == F.substring(token["theirs"], 1, 1), F.lit(False)) & (~first | same)
        return F.when(token["own"].rlike(f"^{MARKS}"), slot).otherwise(same)

    def contradicted(token: Column) -> Column:
        """The last place before a slot where its value stood for another one."""
        return F.coalesce(F.array_max(F.transform(F.filter("slots", lambda slot: (slot["at"] < token["at"]) & (slot["own"] == token["own"])
                                                  & ~slot["theirs"].eqNullSafe(token["theirs"])), lambda slot: slot["at"])), F.lit(-1))
    pairs = pairs.withColumn("steps", F.transform("tokens", lambda token: F.struct(
        agree(token).alias("agree"), F.when(token["own"].rlike(f"^{MARKS}"), contradicted(token)).otherwise(-1).alias("bar")))).drop("tokens")

    def step(state: Column, token: Column) -> Column:
        start = F.when(token["agree"], F.greatest(state["start"], token["bar"] + 1)).otherwise(state["at"] + 1)
        longer = state["at"] + 1 - start > state["n"]
        return F.struct((state["at"] + 1).alias("at"), start.alias("start"), F.when(longer, state["at"] + 1 - start).otherwise(state["n"]).alias("n"),
                        F.when(longer, start).otherwise(state["first"]).alias("first"))
    begin = F.struct(*[F.lit(0).alias(name) for name in ("at", "start", "n", "first")])
    # A generator, as a filter on the run would else be moved below it and compute the run a second time.
    pairs = pairs.withColumn("run", F.explode(F.array(F.aggregate("steps", begin, step)))).drop("steps")
    inside = F.filter("slots", lambda slot: (slot["at"] >= F.col("run.first")) & (slot["at"] < F.col("run.first") + F.col("run.n")))
    return pairs.withColumn("slots", inside).select(
        "doc_id", "item_id", "item_tokens", F.col("run.n").alias("n_tokens"),
        F.size(F.array_distinct(F.transform("slots", lambda slot: F.struct(slot["own"], slot["theirs"])))).alias("n_slots"),
        F.forall("slots", lambda slot: slot["own"] == slot["theirs"]).alias("verbatim"))
