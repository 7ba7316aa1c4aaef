"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target over its size says how often each of its documents is wanted:
some whole copies, and for the rest of the mass one more copy with a
probability. Two documents meet and mass moves from one to the other, in either
direction at odds that keep both expectations, until one of the two holds no
part of a copy or a whole one. It is settled; the other goes on. So the mass of
a source never changes, and each meeting settles a document.

Documents meet in a reduction tree: a hash deals a source's documents of about
one size into groups of a bounded number, each group leaves at most one
document unsettled, and the next level deals those. A bounded number of
documents of every size is held back from the tree as change. What the tree
leaves of a source and then its change meet from the largest to the smallest. The
change's documents all hold the same part of a copy, so the rest of them is one
unit that can meet any other: with it meets a document that would outlast all
that follow for its size. The document left at the end is thus a small one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import land

SPACE = "[\\x20\\x09-\\x0D]+"
# Parts of a word in which mass is counted, so that it is whole numbers and nothing is lost in sums.
PARTS = 1 << 20
GROUP = 256
# About as many documents of each size class of a source are held back from the tree.
HELD = 32

_UNIT = "struct<mass:bigint,size:bigint,doc_id:bigint,n:bigint>"
_STATE = f"struct<going:{_UNIT},settled:array<{_UNIT}>>"
_POOL = f"struct<going:{_UNIT},settled:array<{_UNIT}>,mass:bigint,room:bigint>"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    pieces = F.split(text, SPACE)
    empty = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - empty).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """Rows (source, source_size, target), one per source; the sizes come from (source, size).

    Sources by code point, NULL last, take ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's
    size, and what it gives back is shared by weight among the others until none
    is above. Each round is one aggregate over the sources; only two sums and
    two counts reach the driver. Where ``share`` exceeds ``most`` every target
    is at its limit.
    """
    totals = land(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    weighed = land(_numbered(totals).withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))).drop("number"), "mix-weights")
    total = float(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped, limit = 0.0, -1, F.col("source_size") * F.lit(float(most))
    while True:
        over = limit < F.col("weight") * F.lit(level)
        row = weighed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)),
                          F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], max(level, (share * total - row[1]) / row[2])
    return weighed.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level) if row[2] else limit).alias("target"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, NULL last, without gathering them: by first character, with sums over those before."""
    first = F.coalesce(F.concat(F.lit("0"), F.substr("source", F.lit(1), F.lit(2))), F.lit("1"))
    headed = sources.withColumn("head", first)
    before = headed.groupBy("head").agg(F.count("*").alias("many")).select(
        F.col("head"), (F.sum("many").over(Window.orderBy("head")) - F.col("many")).alias("before"))
    return headed.join(before, "head").withColumn(
        "number", F.col("before") + F.row_number().over(Window.partitionBy("head").orderBy(F.asc_nulls_last("source"))) - 1).drop("head", "before")


def _gain(unit: Column, going: Column, up: Column, down: Column, seed: int) -> Column:
    """``up`` or ``-down`` at the odds that expect nothing, drawn by what is known of the two that meet."""
    bits = F.xxhash64(F.lit(seed), unit["doc_id"], unit["size"], unit["mass"], going["doc_id"], going["size"], going["mass"])
    draw = F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))
    return F.when(draw * (up + down).cast("double") < down.cast("double"), up).otherwise(-down)


def _unit(unit: Column, mass: Column) -> Column:
    return F.struct(mass.alias("mass"), unit["size"].alias("size"), unit["doc_id"].alias("doc_id"), unit["n"].alias("n"))


def _meet(state: Column, unit: Column, seed: int) -> Column:
    """One meeting: the unit and the one under way exchange mass, and whoever is whole is settled."""
    going, settled = state["going"], state["settled"]
    full, other = going["size"] * PARTS, unit["size"] * PARTS
    up = F.least(full - going["mass"], unit["mass"])
    down = F.least(going["mass"], other - unit["mass"])

    def part(gain: Column) -> Column:
        a, b = _unit(going, going["mass"] + gain), _unit(unit, unit["mass"] - gain)
        a_whole = (a["mass"] == 0) | (a["mass"] == full)
        b_whole = (b["mass"] == 0) | (b["mass"] == other)
        return (F.when(a_whole & b_whole, F.struct(F.lit(None).cast(_UNIT).alias("going"), F.concat(settled, F.array(a, b)).alias("settled")).cast(_STATE))
                .when(a_whole, F.struct(b.alias("going"), F.concat(settled, F.array(a)).alias("settled")).cast(_STATE))
                .otherwise(F.struct(a.alias("going"), F.concat(settled, F.array(b)).alias("settled")).cast(_STATE)))
    return F.when(going.isNull(), F.struct(unit.alias("going"), settled.alias("settled")).cast(_STATE)).otherwise(
        _let(_gain(unit, going, up, down, seed), part))


def _chain(units: str, seed: int) -> Column:
    """Meetings along an array: the unit still under way, if any, and those settled."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("going"), F.array().cast(f"array<{_UNIT}>").alias("settled")).cast(_STATE)
    return F.aggregate(units, start, lambda state, unit: _meet(state, _unit(unit, unit["mass"]), seed))


def _reduced(units: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Each group of (keys, mass, size, doc_id, n) as rows (keys, done, mass, size, doc_id, n): all but at most one settled.

    A group goes from its largest unit to its smallest.
    """
    packed = F.sort_array(F.collect_list(F.struct("size", "doc_id", "mass", "n")), asc=False)
    grouped = units.groupBy(*keys).agg(packed.alias("units")).select(*keys, _chain("units", seed).alias("state"))
    left = F.when(F.col("state.going").isNotNull(), F.array(F.struct(F.lit(False).alias("done"), F.col("state.going").alias("unit")))).otherwise(F.array())
    rows = F.concat(F.transform("state.settled", lambda unit: F.struct(F.lit(True).alias("done"), unit.alias("unit"))), left)
    return grouped.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.done", "row.unit.mass", "row.unit.size", "row.unit.doc_id", "row.unit.n")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = (5, 2, 1), seed: int = 1,
        group: int = GROUP, held: int = HELD) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, copies, taken), one per row of ``docs``.

    ``size`` counts words, ``target`` is the words wanted of the source (see
    ``source_targets``), ``copies`` how often the document is taken and
    ``taken`` the words this makes. A document is taken as often as its target
    over its size says, rounded down or up, at an expectation of exactly that,
    unless it outweighs all smaller ones of its source: then it goes to the
    whole the others can make up for. The copies of a source add up to its
    target but for the last document under way, which goes to the nearer whole. Whole copies are at most ``most``, and
    reruns agree: draws depend on ids, sizes and ``seed`` only.

    A NULL or empty text has no words and is taken without effect. NULL is a
    source of its own, apart from "". Rows equal in id, source and size are one
    unit with a count, so that an id repeated on many rows (NULL too) gathers
    nowhere: as many of them as their mass says take one more copy. An empty
    table gives an empty result; other columns are ignored.
    """
    sized = land(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             words_of(F.coalesce(F.col("text"), F.lit(""))).alias("size")), "mix-sizes")
    targets = land(source_targets(sized, share, most, weights), "mix-targets")
    same = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    # As many rows as sources: joined by whatever means their measured size allows.
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    wanted = same.join(targets, same["source"].eqNullSafe(targets["source"])).select(
        same["source"], "doc_id", "size", "n", ratio.alias("ratio"))
    base = F.floor("ratio").cast("long")
    mass = F.round((F.col("ratio") - base) * F.col("size") * PARTS).cast("long")
    whole = F.when(F.col("size") > 0, F.floor(F.col("n") * F.col("part") / (F.col("size") * PARTS))).otherwise(0).cast("long")
    units = wanted.withColumns({"base": base, "part": mass}).withColumn("certain", whole).withColumn(
        "mass", F.col("n") * F.col("part") - F.col("certain") * F.col("size") * PARTS)
    units = land(units.withColumn("band", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")))).otherwise(0).cast("int")).select(
        "source", "band", "doc_id", "size", "n", "base", "certain", "mass"), "mix-units")
    extra = land(_rounded(units.filter("mass > 0"), seed, group, held), "mix-extra")
    # A unit is named by source, id and size.
    joined = units.join(extra.withColumnsRenamed({"source": "_source", "doc_id": "_doc", "size": "_size"}).select("_source", "_doc", "_size", "extra"),
                        units["source"].eqNullSafe(F.col("_source")) & units["doc_id"].eqNullSafe(F.col("_doc")) & (units["size"] == F.col("_size")), "left")
    more = F.col("certain") + F.coalesce("extra", F.lit(0))
    rows = joined.withColumn("more", more).withColumn("copies", F.explode(F.array(
        F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("rows")),
        F.struct(F.col("base").alias("copies"), (F.col("n") - F.col("more")).alias("rows"))))).filter("copies.rows > 0")
    rows = rows.select("source", "doc_id", "size", F.col("copies.copies").alias("copies"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies.rows"))).alias("again"))
    return rows.join(targets.withColumnRenamed("source", "_of"), rows["source"].eqNullSafe(F.col("_of"))).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _rounded(units: DataFrame, seed: int, group: int, held: int) -> DataFrame:
    """Rows (source, doc_id, size, extra) for units with part of a copy: ``extra`` is 1 where it became a whole one."""
    keys = ["source", "band"]
    bits = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", F.lit("held")), F.lit(1 << 30))
    counts = units.groupBy(*keys).agg(F.count("*").alias("many")).withColumnsRenamed({"source": "_of", "band": "_band"})
    dealt = units.join(counts, units["source"].eqNullSafe(F.col("_of")) & (units["band"] == F.col("_band"))).withColumn(
        "change", (F.col("n") == 1) & (bits * F.col("many") < F.lit(held << 30)))
    columns = ["source", "band", "mass", "size", "doc_id", "n"]
    dealt = land(dealt.select(*columns, "many", "change"), "mix-dealt")
    change = dealt.filter("change").select(*columns)
    going, many = dealt.filter("not change").select(*columns, "many"), dealt.agg(F.coalesce(F.max("many"), F.lit(0))).first()[0]
    settled, level = [], 0
    while many > 1:
        level += 1
        # About half a group each, so that hardly any holds more than a whole one.
        groups = F.ceil(F.col("many") * 2 / F.lit(group)).cast("long")
        cell = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "mass"), groups)
        tree = land(_reduced(going.withColumn("groups", groups).withColumn("cell", cell), [*keys, "groups", "cell"], seed), f"mix-level-{level}")
        settled.append(tree.filter("done"))
        going = tree.filter("not done").withColumn("many", F.col("groups")).select(*columns, "many")
        many = 1 if many * 2 <= group else -(-many * 2 // group)
    whole = land(_changed(change, going, seed), "mix-last")
    for tree in settled:
        whole = whole.unionByName(tree.select("source", "mass", "size", "doc_id"))
    return whole.select("source", "doc_id", "size", F.when(F.col("mass") * 2 >= F.col("size") * PARTS, 1).otherwise(0).alias("extra"))


def _changed(change: DataFrame, going: DataFrame, seed: int) -> DataFrame:
    """The last meetings of each source: what the tree left, then the change.

    Rows (source, mass, size, doc_id); a bounded number of units per source and size class. The change is kept as two sums,
    its mass and the mass that would fill it, as every document in it holds the same part.
    """
    def sorted_list(wanted: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(wanted, F.struct("size", "doc_id", "mass", "n"))), asc=False)
    both = change.withColumn("change", F.lit(True)).unionByName(going.withColumn("change", F.lit(False)), allowMissingColumns=True)
    lists = both.groupBy("source").agg(sorted_list(~F.col("change")).alias("left"), sorted_list(F.col("change")).alias("change"))
    met = lists.select("source", "change", _chain("left", seed).alias("met"))

    def total(value: str) -> Column:
        return F.aggregate("change", F.lit(0).cast("long"), lambda all_, unit: all_ + unit[value])
    start = F.struct(F.col("met.going").alias("going"), F.col("met.settled").alias("settled"), total("mass").alias("mass"),
                     (total("size") * PARTS).alias("room")).cast(_POOL)
    done = F.aggregate("change", start, lambda state, unit: _change_meets(state, unit, seed),
                       lambda state: F.concat(state["settled"], F.filter(F.array(state["going"]), lambda unit: unit.isNotNull())))
    return met.select("source", F.explode(done).alias("unit")).select("source", "unit.mass", "unit.size", "unit.doc_id")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _change_meets(state: Column, unit: Column, seed: int) -> Column:
    """The next document of the change, the largest left, takes its share and meets the unit under way.

    One at least twice as large would outlast all that follow. It first meets the whole change, which settles it unless both
    its wholes outweigh the change; then the change is whole, and the unit is rounded in the end.
    """
    outsized = F.coalesce(state["going"]["size"] >= 2 * unit["size"], F.lit(False))
    return _let(F.when(outsized, _with_change(state, seed)).otherwise(state), lambda pool: _let(
        _share(pool, unit), lambda share: _taken(pool, _unit(unit, share), seed)))


def _with_change(state: Column, seed: int) -> Column:
    """The unit under way and the change as a whole exchange mass; the unit goes to the settled ones.

    Where the change can make up for one whole only, the unit goes to that one.
    """
    going, mass = state["going"], state["mass"]
    lacks, gives, room = going["size"] * PARTS - going["mass"], mass, state["room"] - mass
    up, down = F.least(lacks, gives), F.least(going["mass"], room)
    whole = F.struct(F.lit(None).cast("long").alias("doc_id"), state["room"].alias("size"), mass.alias("mass"))
    drawn = (F.when((lacks > gives) & (going["mass"] <= room), -down).when((lacks <= gives) & (going["mass"] > room), up)
             .otherwise(_gain(whole, going, up, down, seed)))
    return _let(drawn, lambda gain: F.struct(
        F.lit(None).cast(_UNIT).alias("going"), F.concat(state["settled"], F.array(_unit(going, going["mass"] + gain))).alias("settled"),
        (mass - gain).alias("mass"), state["room"].alias("room")).cast(_POOL))


def _share(pool: Column, unit: Column) -> Column:
    """What a document of the change holds: its part of the mass, so that the others have room for the rest."""
    full = unit["size"] * PARTS
    part = F.round(pool["mass"].cast("double") / pool["room"] * full).cast("long")
    return F.greatest(F.least(part, full, pool["mass"]), pool["mass"] - (pool["room"] - full))


def _taken(pool: Column, unit: Column, seed: int) -> Column:
    """The pool without a document, which is settled if it is whole and else meets the unit under way."""
    full = unit["size"] * PARTS
    whole = (unit["mass"] == 0) | (unit["mass"] == full)
    passed = F.struct(pool["going"].alias("going"), F.concat(pool["settled"], F.array(unit)).alias("settled")).cast(_STATE)
    now = F.when(whole, passed).otherwise(_meet(pool, unit, seed))
    return _let(now, lambda met: F.struct(met["going"].alias("going"), met["settled"].alias("settled"), (pool["mass"] - unit["mass"]).alias("mass"),
                                          (pool["room"] - full).alias("room")).cast(_POOL))
