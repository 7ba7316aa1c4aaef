"""Ordered scans per key that never gather one key into one task.

A plain window over ``partitionBy(key).orderBy(ts)`` sorts all rows of a key in
one task.  Here busy keys are cut into chunks along their order.  The window runs
per (key, chunk); what crosses a chunk border comes from a per-chunk summary,
which is a map-side combined aggregate with one row per (key, chunk).

Where a chunk ends is learnt from the data: the busiest keys are found by a
count, a sample of their rows sorted, and every so manieth place of it is a
splitter.  A splitter is a place in the whole order, ties included, so neither a
busy second nor a million rows with one value end up in one chunk; rows that tie
in the whole order are told apart by a hash of all they hold.  The sample is
drawn by hashes, so a lost task that runs again cuts alike, and the splitters
change how work is split, never the answer.  All other keys are one chunk each.

The caller may also say how to cut: by an expression that does not decrease
along the order, or by time into spans of ``width`` seconds.  Rows without an
instant are then a chunk of their own, ahead of all others, as NULL sorts first.

Rows whose key is NULL belong to no series and get no neighbour and no total.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import names
from ..functions.times import seconds

DAY = 86400.0
# The chunk of rows without an instant: before every other.
UNDATED = -(1 << 63)

# Keys with more rows than this are cut, but no more chunks are made than may be broadcast.
CHUNK_ROWS = 250_000
MAX_CHUNKS = 1 << 15
# Rows sampled for every chunk.
SAMPLED = 16
# Splitters are looked up in a tree of this fan, so a node holds no more than that many.
FAN = 32

_CHUNK = "_chunk"
_CARRY = "_carry"
_SPLITS = "_splits"
_NODE = "_node"
_TREE = "_tree"
_PLACE = "_place"
_AT = "_at"
_HASH = "_hash"
_ALL = "_all"


def range_of(col: str, width: int) -> Column:
    """Chunk by a range of numbers; unique numbers make it hold at most ``width`` rows."""
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def time_chunk(ts: str, width: float = DAY) -> Column:
    """Chunk by spans of ``width`` seconds; NULL has its own chunk, the first."""
    return F.coalesce(F.floor(seconds(ts) / F.lit(width)).cast("long"), F.lit(UNDATED))


def _has_keys(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def _spread(df: DataFrame, keys: Sequence[str], cut: Column) -> Column:
    """The chunk of a row; rows without a key need no order and are dealt by a hash of all they hold."""
    if not keys:
        return cut
    return F.when(_has_keys(keys), cut).otherwise(_row_hash(df))


def _row_hash(df: DataFrame) -> Column:
    plain = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain)


def _sorted(order: Sequence[str | Column]) -> list[Column]:
    """Sort expressions; a name after a minus sign sorts downwards, NULL last."""
    return [col if isinstance(col, Column) else F.desc(col[1:]) if col.startswith("-") else F.asc(col) for col in order]


def _place(df: DataFrame, order: Sequence[str | Column]) -> Column:
    """A value that never decreases along the order. It stops before a column that sorts downwards and is no number."""
    kinds, parts = dict(df.dtypes), []
    for col in order:
        if isinstance(col, Column):
            raise ValueError("an order to be cut by itself is given as names")
        if not col.startswith("-"):
            parts.append(F.col(col))
            continue
        name = col[1:]
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kinds[name].startswith("decimal"):
            break
        value = F.col(name).cast("double")
        parts += [F.col(name).isNull(), F.when(F.isnan(value), F.lit(float("-inf"))).otherwise(-value)]
    else:
        parts.append(F.col(_HASH))
    return F.struct(*[part.alias(f"c{i}") for i, part in enumerate(parts)])


def splitters(df: DataFrame, keys: Sequence[str], place: Column, rows: int = CHUNK_ROWS, most: int = MAX_CHUNKS) -> DataFrame:
    """Rows (keys, _splits) of the busiest keys: ascending places that cut a key into chunks of about ``rows`` rows.

    At most ``most`` keys with more than ``rows`` rows, and about ``most``
    splitters in all; beyond that chunks grow. Keys that are not among the
    busiest hold less than one part in ``most`` of all rows.
    """
    known = df.filter(_has_keys(keys))
    # A heap of the busiest keys, not a sort of all.
    busy = known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).orderBy(F.desc("_n"), *keys).limit(most)
    total = Window.partitionBy(F.lit(0))
    chunks = F.ceil(F.col("_n") / F.greatest(F.lit(float(rows)), F.sum("_n").over(total) / F.lit(float(most))))
    wanted = busy.select(*keys, (chunks * SAMPLED / F.col("_n")).alias("_rate"))
    drawn = F.pmod(F.xxhash64(place, F.lit("splitters")), F.lit(1 << 30)) < F.col("_rate") * F.lit(1 << 30)
    sample = known.join(F.broadcast(wanted), list(keys)).filter(drawn).groupBy(*keys).agg(F.sort_array(F.collect_list(place)).alias("_sample"))
    return sample.select(*keys, F.filter("_sample", lambda _, i: i % SAMPLED == SAMPLED - 1).alias(_SPLITS))


def _search(df: DataFrame, most: int) -> DataFrame:
    """Add ``_at``: how many of at most ``most`` splitters a place has reached, by halving; 0 where there are none.

    Every step is a projection of its own, so that Spark compiles it; a lambda would be interpreted for each row.
    The planner puts each step in place of its name in the next, where it stands twice. It cannot do so beyond a generator.
    """
    out = df.withColumn(_AT, F.lit(0))
    for bit in reversed(range(most.bit_length())):
        at = F.col(_AT)
        out = out.withColumn(_AT, at + F.when(F.get(_SPLITS, at + ((1 << bit) - 1)) <= F.col(_PLACE), 1 << bit).otherwise(0))
    return out.withColumn(_AT, F.explode(F.array(_AT)))


def _levels() -> list[tuple[int, int, int]]:
    """Of each level of the tree: splitters under one of a node's, under the whole node, and the most that a node holds."""
    return [(FAN * FAN, 1 << 40, 2 * FAN), (FAN, FAN * FAN, FAN - 1), (1, FAN, FAN - 1)]


def _tree(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, _node, _splits) of the splitters of each key as a tree of three levels.

    A leaf holds ``FAN`` splitters in a row, a node above the last splitter of
    each of ``FAN`` full leaves, the root the last of each full node. A node is
    numbered by its level (0 for the root) and the first splitter under it.
    """
    each = splits.select(*keys, F.posexplode(_SPLITS).alias("_i", "_split"))
    levels = F.filter(
        F.array(*[F.struct(F.lit(level).alias("level"), F.lit(under).alias("under"), F.lit(above).alias("above"))
                  for level, (under, above, _) in enumerate(_levels())]),
        lambda level: (F.col("_i") + 1) % level["under"] == 0)
    placed = each.withColumn("_level", F.explode(levels))
    first = F.col("_i") - F.col("_i") % F.col("_level.above")
    return placed.groupBy(*keys, _node(F.col("_level.level"), first).alias(_NODE)).agg(F.sort_array(F.collect_list("_split")).alias(_SPLITS))


def _node(level: Column, first: Column) -> Column:
    return level.cast("long") * F.lit(1 << 40) + first


def _trees(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (keys, _tree) for each key: the nodes of each level in their order, which have no gap."""
    nodes = _tree(splits, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(_NODE, _SPLITS))).alias(_TREE))

    def of_level(level: int) -> Column:
        return F.transform(F.filter(_TREE, lambda node: F.shiftright(node[_NODE], 40) == level), lambda node: node[_SPLITS])
    return nodes.select(*keys, F.array(*[of_level(level) for level in range(len(_levels()))]).alias(_TREE))


def _chunked(df: DataFrame, trees: DataFrame, keys: Sequence[str], place: Column, how: str) -> DataFrame:
    """``df`` with the chunk of each row: how many splitters of its key it has reached, level by level.

    One join finds the tree of a key. Compiled code looks into it where it was
    broadcast and hands on a number, so that no row is written with splitters in it.
    """
    out = df.withColumns({_PLACE: place, _CHUNK: F.lit(0).cast("long")}).join(trees, list(keys), how)
    for level, (under, above, most) in enumerate(_levels()):
        out = out.withColumn(_SPLITS, F.get(F.get(_TREE, F.lit(level)), F.floor(F.col(_CHUNK) / F.lit(above)).cast("int")))
        out = _search(out, most).withColumn(_CHUNK, F.col(_CHUNK) + F.lit(under) * F.col(_AT)).drop(_SPLITS, _AT)
    return out.drop(_PLACE, _TREE)


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with the chunk of each row, and the rows of busy keys alone, which are the only ones with borders."""
    place = _place(df, order)
    trees = F.broadcast(_trees(splitters(df, keys, place, rows), keys))
    spread = F.col(_CHUNK) if keys == [_ALL] else F.when(_has_keys(keys), F.col(_CHUNK)).otherwise(F.col(_HASH))
    return _chunked(df, trees, keys, place, "left").withColumn(_CHUNK, spread), _chunked(df, trees, keys, place, "inner")


def _prepared(df: DataFrame, by: Iterable[str] | str | None) -> tuple[DataFrame, list[str]]:
    keys = names(by)
    hashed = df.withColumn(_HASH, _row_hash(df))
    # One key for all rows: always 0, but no constant, which would turn the joins on it into cross products.
    return (hashed, list(keys)) if keys else (hashed.withColumn(_ALL, F.pmod(_HASH, F.lit(1))), [_ALL])


def _neighbour(df: DataFrame, by: Iterable[str] | str | None, order: Sequence[str], values: Sequence[str],
               chunk: Column | None, out: str, step: int, width: float | None, rows: int) -> DataFrame:
    pack = F.struct(*values)
    near, hop = (F.lag, F.lag) if step < 0 else (F.lead, F.lead)
    sampled = chunk is None and width is None
    if sampled:
        data, keys = _prepared(df, by)
        order = [*order, _HASH]
        whole, bordered = _cut(data, keys, order[:-1], rows)
    else:
        keys = names(by)
        cut = time_chunk(order[0], width) if chunk is None else F.coalesce(chunk, F.lit(UNDATED))
        whole = df.withColumn(_CHUNK, _spread(df, keys, cut))
        bordered = df.filter(_has_keys(keys)).withColumn(_CHUNK, cut)
    rank = F.struct(*order)
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(_CHUNK)
    edge = F.max_by(pack, rank) if step < 0 else F.min_by(pack, rank)
    carry = (
        bordered.groupBy(*keys, _CHUNK).agg(edge.alias("_edge"))
        .select(*keys, _CHUNK, hop("_edge").over(outer).alias(_CARRY))
        .filter(F.col(_CARRY).isNotNull())
    )
    found = whole.withColumn(out, near(pack).over(inner)).join(carry, [*keys, _CHUNK], "left")
    return found.withColumn(out, F.when(_has_keys(keys), F.coalesce(out, _CARRY))).drop(_CHUNK, _CARRY, _HASH, _ALL)


def with_previous(df: DataFrame, by: Iterable[str] | str | None, order: Sequence[str], values: Sequence[str],
                  chunk: Column | None = None, out: str = "prev", width: float | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: a struct of ``values`` from the row before, per key; keys with more than ``rows`` rows are cut."""
    return _neighbour(df, by, order, values, chunk, out, -1, width, rows)


def with_next(df: DataFrame, by: Iterable[str] | str | None, order: Sequence[str], values: Sequence[str],
              chunk: Column | None = None, out: str = "next", width: float | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: a struct of ``values`` from the row after, per key; keys with more than ``rows`` rows are cut."""
    return _neighbour(df, by, order, values, chunk, out, 1, width, rows)


def running(df: DataFrame, by: Iterable[str] | str | None, order: Sequence[str | Column], chunk: Column | None = None,
            sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None,
            before: bool = False, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add running sums and maxima per key, up to this row or only the rows before it.

    ``order`` holds names, with a minus sign in front where they sort downwards
    (NULL last). A chunk that is given must be known for every row that has a
    key: a NULL chunk is an error.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    inputs = {f"_in_{name}": col for name, col in {**sums, **maxima}.items()}
    sampled = chunk is None
    if sampled:
        data, keys = _prepared(df.withColumns(inputs), by)
        whole, bordered = _cut(data, keys, order, rows)
        order = [*order, _HASH]
    else:
        data, keys = df.withColumns(inputs), names(by)
        cut = F.coalesce(chunk.cast("long"), F.raise_error(F.lit("a chunk of a running total is NULL")).cast("long"))
        whole = data.withColumn(_CHUNK, _spread(data, keys, cut))
        bordered = data.filter(_has_keys(keys)).withColumn(_CHUNK, cut)
    last = -1 if before else Window.currentRow
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, last)
    outer = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = bordered.groupBy(*keys, _CHUNK).agg(
        *[F.sum(f"_in_{name}").alias(name) for name in sums],
        *[F.max(f"_in_{name}").alias(name) for name in maxima],
    )
    carry = totals.select(
        *keys, _CHUNK,
        *[F.sum(name).over(outer).alias(f"_before_{name}") for name in sums],
        *[F.max(name).over(outer).alias(f"_before_{name}") for name in maxima],
    )
    summed = whole.withColumns({
        **{name: F.sum(f"_in_{name}").over(inner) for name in sums},
        **{name: F.max(f"_in_{name}").over(inner) for name in maxima},
    })
    out = summed.join(carry, [*keys, _CHUNK], "left")
    both = {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)) for name in sums}
    best = {name: F.greatest(name, f"_before_{name}") for name in maxima}
    known = {name: F.when(_has_keys(keys), col) for name, col in {**both, **best}.items()}
    return out.withColumns(known).drop(_CHUNK, _HASH, _ALL, *inputs, *[f"_before_{name}" for name in known])
