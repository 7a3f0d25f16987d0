"""Mixing sources to target weights: blocks of words, multinomial shards, pseudorandom order, join by index.

The words of a source's documents lie on one line, cut into blocks of fixed length.
The mix is a number of shards of slots, equal but for one slot. Every slot of a shard falls on a source with the
source's share as its chance, so a shard's counts are multinomial. Of a source's slots, numbered through all shards,
slot q takes the block that a pseudorandom permutation of the source puts at place q modulo
its number of blocks, so every block is taken once before any is taken again. Blocks
meet the documents that lie in them by (source, index).

Totals are settled once, after all shards are drawn. A source's quota is its target at the words its blocks hold on
average. Drawn alone, a source of s slots would miss it by about sqrt(s); so slots
beyond the quota are given up, and sources that were drawn less often get as many more, in shards by hash. About
0.4 * sqrt(s) slots of a source change hands, and its taken words then differ from the target by what its
blocks differ in length. The permutation is
a four-round Feistel network over a grid just large enough, walked on while it
leaves the range. All of it is column expressions, and hashes stand for
random numbers: reruns agree on any cluster.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share
``share`` times all words, none more than ``most_repeats`` times its own; what
a source cannot take is reshared by weight. In closed form every target is
least(limit, weight * level), with the greatest level over the sources in order of
limit / weight.

Scale: slots are unfolded from a row a shard, so Spark's estimate of their size is far too small; the join by
index is asked to shuffle, or it would broadcast them. A slot finds its source by a join on a grid over the shares,
which has as many cells as there are sources: it meets two sources on average, whatever the shares, and only sources that
were drawn make a row of a shard. Numbers and running sums of sources are taken in ranges; the water level needs a row for
each different size of a source, at most about the root of twice the number of words. Text is read once for its size, and once more where texts are wanted.
Positions are prefix sums in two levels over about sqrt(rows) chunks of each source,
so a source with a third of all rows is spread over all tasks. Tables per source
have one row a source.

Defined results: a null or empty text has size 0 and is not taken; repeated rows
are documents of their own in ``mix_report``; in ``mix_documents`` rows that
repeat both id and text count once; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislefix.operators.encode import numbered
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import materialize

# Fixed values of the task: the repeating weights, and what a word is.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_WHITE = r"[\x20\x09-\x0D]"

#: Steps of the walk back into range; a step stays outside with a chance under 1 / sqrt(blocks).
_WALK = 24
#: Shares are counted in so many parts of a slot.
_UNITS = 1 << 20
#: Cells of the grid over the shares; beyond so many sources a slot meets more than two on average.
_MOST_CELLS = 1 << 22
#: The grid is sent to all executors if it has no more rows than this; a larger one is shuffled.
_BROADCAST_ROWS = 1 << 15


@dataclass(frozen=True)
class MixSettings:
    share: float = 1.5
    most_repeats: int = 2
    block_words: int = 32
    shard_slots: int = 4096
    seed: int = 8


def _sized(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Size, source and a row number of each row, stored: the texts are not read again."""
    words = F.coalesce(F.regexp_count(df[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    name = df[source].cast("string")
    rows = df.select(
        df[key].alias("k"), name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("null")).alias("sk"),
        words.alias("n"), F.xxhash64(df[text]).alias("h"), F.monotonically_increasing_id().alias("uid"),
    )
    return materialize(rows, "sized")


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """One row a source: its size, target, number of blocks, quota of slots, and its stretch of the shares, from ``low`` on."""
    sums = sized.groupBy("sk", "source").agg(F.sum("n").alias("source_size"))
    ordered = sums.select(F.col("source").isNull().alias("last"), "source", "sk", "source_size")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = numbered(ordered, "place").drop("last").withColumn("weight", weight)
    weighed = weighed.withColumn("limit", (settings.most_repeats * F.col("source_size")).cast("double"))
    counted = weighed.agg(F.count("*").alias("sources"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    level = _water_level(weighed, settings.share * counted.words)
    # A source's slots follow from the words its blocks hold on average; whole units, so that sums do not depend on order.
    blocks = F.ceil(F.col("source_size") / settings.block_words)
    wanted = F.when(F.col("source_size") > 0, blocks * F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = weighed.withColumn("target", F.least("limit", F.col("weight") * level)).withColumn("blocks", blocks)
    aimed = materialize(aimed.withColumn("units", F.round(wanted * _UNITS).cast("bigint")), "aimed")
    # Running sums over blocks of sources, then inside a block.
    part = aimed.withColumn("part", F.shiftright("place", 12))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    parts = part.groupBy("part").agg(F.sum("units").alias("part_units"))
    parts = parts.select("part", F.coalesce(F.sum("part_units").over(before), none).alias("part_low"))
    lined = part.withColumn("inner_low", F.coalesce(F.sum("units").over(inside), none)).join(parts, "part")
    lined = lined.withColumn("low", F.col("part_low") + F.col("inner_low"))
    # Rounded at the ends of the stretches, quotas add up to the number of slots.
    rounded = lambda end: F.floor((end + _UNITS // 2) / F.lit(_UNITS)).cast("bigint")
    quota = F.least(rounded(F.col("low") + F.col("units")) - rounded(F.col("low")), settings.most_repeats * F.col("blocks"))
    units = aimed.agg(F.sum("units").alias("units")).first().units or 0
    slots = (units + _UNITS // 2) // _UNITS
    return lined.select(
        "sk", "source", "source_size", "target", "blocks", "low", "units", quota.alias("quota"),
        F.lit(units).cast("bigint").alias("all_units"), F.lit(slots).cast("bigint").alias("slots"),
        F.lit(counted.sources).cast("bigint").alias("sources"),
    )


def _water_level(weighed: DataFrame, total: float) -> float:
    """The level at which least(limit, weight * level) adds up to ``total`` over the sources, as far as limits allow."""
    steps = weighed.groupBy((F.col("limit") / F.col("weight")).alias("full_at"))
    steps = steps.agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights"))
    filling = Window.orderBy("full_at")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(total) - F.coalesce(F.sum("limits").over(before), F.lit(0.0))
    return steps.select((left / F.sum("weights").over(onward)).alias("level")).agg(F.max("level").alias("level")).first().level or 0.0


def _hashed(*columns: Column | str, below: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), below)


def permuted(df: DataFrame, index: Column, count: Column, key: Column, seed: int, name: str) -> DataFrame:
    """``df`` with a column ``name``: where a permutation of 0 to ``count`` - 1, one for each ``key``, takes ``index``.

    The rounds are columns that build on each other, so that none is computed twice; the few rows that
    land outside the range walk on in a loop.
    """
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(count.cast("double")))).cast("bigint")
    high = F.floor((count + F.col("_wide") - 1) / F.col("_wide")).cast("bigint")
    grid = df.withColumn("_wide", wide).withColumn("_high", high).withColumn("_key", F.xxhash64(key))
    wide, high, key = F.col("_wide"), F.col("_high"), F.col("_key")

    def mixed(x: Column, turn: int, below: Column) -> Column:
        return _hashed(x, key, F.lit(seed + turn), below=below)

    def network(x: Column) -> Column:
        a, b = F.floor(x / high).cast("bigint"), F.pmod(x, high)
        for turn in (0, 2):
            a = F.pmod(a + mixed(b, turn, wide), wide)
            b = F.pmod(b + mixed(a, turn + 1, high), high)
        return a * high + b

    x, a, b = index.cast("bigint"), F.col("_a"), F.col("_b")
    grid = grid.withColumns({"_a": F.floor(x / high).cast("bigint"), "_b": F.pmod(x, high)})
    for turn in (0, 2):
        grid = grid.withColumn("_a", F.pmod(a + mixed(b, turn, wide), wide))
        grid = grid.withColumn("_b", F.pmod(b + mixed(a, turn + 1, high), high))
    grid = grid.withColumn("_first", a * high + b)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)), F.col("_first"), lambda x, _: F.when(x < count, x).otherwise(network(x))
    )
    grid = grid.withColumn("_walked", F.when(F.col("_first") < count, F.col("_first")).otherwise(walked))
    inside = F.when(F.col("_walked") < count, F.col("_walked"))
    found = grid.withColumn(name, inside.otherwise(F.raise_error(F.lit("permutation left its range")).cast("bigint")))
    return found.drop("_wide", "_high", "_key", "_a", "_b", "_first", "_walked")


def shard_count(sources: DataFrame, settings: MixSettings) -> int:
    size = sources.select("slots").first()
    return max(1, -(-size.slots // settings.shard_slots)) if size else 1


def drawn_counts(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """``shard, sk, count``: how many of its slots each shard draws for a source; sources not drawn make no row."""
    spark = sources.sparkSession
    size = sources.select("slots", "all_units", "sources").first()
    slots, units, count = size or (0, 0, 0)
    shards = shard_count(sources, settings)
    cells = max(1, min(count, _MOST_CELLS))
    width = max(1, -(-units // cells))
    # Each cell of the grid lists the sources whose stretch it touches.
    ends = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("units") - 1) / width))
    grid = sources.where("units > 0").select("sk", "low", (F.col("low") + F.col("units")).alias("high"), F.explode(ends).alias("cell"))
    grid = grid.hint("broadcast" if cells + count <= _BROADCAST_ROWS else "merge")
    all_shards = spark.range(0, shards if slots else 0, 1, _tasks(sources)).withColumnRenamed("id", "shard")
    share = lambda shard: F.floor(shard * slots / shards).cast("bigint")
    own = share(F.col("shard") + 1) - share(F.col("shard"))
    drawn = all_shards.where(own > 0).select("shard", F.explode(F.sequence(F.lit(1).cast("bigint"), own)).alias("j"))
    point = _hashed(F.col("shard"), F.col("j"), F.lit(settings.seed), below=F.lit(max(1, units)).cast("bigint"))
    drawn = drawn.select("shard", point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    met = drawn.join(grid, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    return met.groupBy("shard", "sk").agg(F.count("*").alias("count"))


def chosen_blocks(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """``sk, block, turn, shard`` for each slot of the mix; ``turn`` counts how often the block was taken before."""
    counts = materialize(drawn_counts(sources, settings), "drawn")
    quotas = sources.where("blocks > 0").select("sk", "blocks", "quota")
    # Shards in groups of about sqrt(shards), so that no task numbers them all.
    shards = shard_count(sources, settings)
    grouped = counts.withColumn("g", F.floor(F.col("shard") / (math.isqrt(shards - 1) + 1)))
    by_group = Window.partitionBy("sk").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("sk", "g").agg(F.sum("count").alias("group_count"))
    sums = sums.select("sk", "g", F.coalesce(F.sum("group_count").over(by_group), F.lit(0)).alias("group_first"))
    in_group = Window.partitionBy("sk", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # A stated number of tasks: a handful of rows here makes very many slots, so they must not be coalesced.
    dealt = spread_join(grouped, quotas, "sk").repartition(_tasks(sources), "sk", "g")
    lined = dealt.withColumn("before", F.coalesce(F.sum("count").over(in_group), F.lit(0)))
    lined = lined.join(sums.hint("merge"), ["sk", "g"]).withColumn("first", F.col("group_first") + F.col("before"))
    # The totals are settled here: no slot beyond the quota, and what was not drawn of it is added.
    lined = lined.withColumn("past", F.least(F.col("first") + F.col("count"), F.col("quota"))).where("past > first")
    kept = lined.select("sk", "blocks", "shard", F.explode(F.sequence("first", F.col("past") - 1)).alias("q"))
    totals = counts.groupBy("sk").agg(F.sum("count").alias("drawn"))
    short = quotas.join(totals, "sk", "left").withColumn("first", F.coalesce("drawn", F.lit(0).cast("bigint")))
    short = short.where("quota > first").select("sk", "blocks", F.explode(F.sequence("first", F.col("quota") - 1)).alias("q"))
    added = short.select("sk", "blocks", _hashed("sk", "q", F.lit(settings.seed), below=F.lit(shards).cast("bigint")).alias("shard"), "q")
    slots = kept.unionByName(added)
    placed = permuted(slots, F.pmod("q", "blocks"), F.col("blocks"), F.col("sk"), settings.seed, "block")
    return placed.select("sk", "block", F.floor(F.col("q") / F.col("blocks")).cast("int").alias("turn"), "shard")


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its first word's place on its source's line."""
    chunks = max(1, math.isqrt(sized.count()))
    dealt = sized.withColumn("c", F.pmod(F.xxhash64("k", "h"), F.lit(chunks)))
    sums = dealt.groupBy("sk", "c").agg(F.sum("n").alias("chunk_words"))
    by_chunk = Window.partitionBy("sk").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sk", "c", F.coalesce(F.sum("chunk_words").over(by_chunk), F.lit(0)).alias("chunk_first"))
    in_chunk = Window.partitionBy("sk", "c").orderBy("k", "h", "uid").rowsBetween(Window.unboundedPreceding, -1)
    lined = dealt.withColumn("before", F.coalesce(F.sum("n").over(in_chunk), F.lit(0))).join(sums, ["sk", "c"])
    placed = lined.select("uid", "k", "h", "sk", "n", (F.col("chunk_first") + F.col("before")).alias("p"))
    return spread_join(placed, sources.select("sk", "source", "source_size", "target"), "sk")


def _overlaps(placed: DataFrame, settings: MixSettings) -> DataFrame:
    """A row for each block a document lies in, with the words it has there; one without a block if it has no word."""
    size = settings.block_words
    first, last = F.floor(F.col("p") / size), F.floor((F.col("p") + F.col("n") - 1) / size)
    spans = placed.withColumn("block", F.explode_outer(F.when(F.col("n") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("block") * size, F.col("p")) - F.col("p")
    end = F.least((F.col("block") + 1) * size, F.col("p") + F.col("n")) - F.col("p")
    return spans.withColumn("begin", begin).withColumn("words", end - begin)


def mix_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings | None = None
) -> DataFrame:
    """``key, size, source_size, target, taken`` of every row: how many of its words the mix takes, repeats counted."""
    settings = settings or MixSettings()
    sized = _sized(df, key, text, source)
    sources = materialize(source_targets(sized, settings), "sources")
    spans = _overlaps(placed_documents(sized, sources), settings)
    times = chosen_blocks(sources, settings).groupBy("sk", "block").agg(F.count("*").alias("times"))
    met = spans.join(times.hint("merge"), ["sk", "block"], "left")
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0))
    found = met.groupBy("uid", "k", "n", "source_size", "target").agg(taken.alias("taken"))
    return found.select(F.col("k").alias(key), F.col("n").alias("size"), "source_size", "target", "taken")


def mix_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings | None = None
) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each stretch of a document that the mix takes at a
    turn, so that no text goes on over words that are not taken.

    A column ``n_chars`` is set to the new text's length.
    """
    settings = settings or MixSettings()
    sized = _sized(df, key, text, source)
    # Rows that repeat both id and text are one document.
    once = sized.groupBy("k", "h", "sk", "source").agg(F.min("n").alias("n"), F.min("uid").alias("uid"))
    once = once.groupBy("k", "h").agg(F.min(F.struct("sk", "source", "n", "uid")).alias("m")).select("k", "h", "m.*")
    sources = materialize(source_targets(once, settings), "sources")
    spans = _overlaps(placed_documents(once, sources), settings).where("n > 0")
    met = spans.join(chosen_blocks(sources, settings).hint("merge"), ["sk", "block"])
    # Blocks that follow one another are one stretch. A document has at most twice its number of blocks of them.
    in_turn = Window.partitionBy("k", "h", "turn").orderBy("block")
    stretched = met.withColumn("stretch", F.col("block") - F.row_number().over(in_turn))
    runs = stretched.groupBy("k", "h", "turn", "stretch").agg(F.min("begin").alias("begin"), F.sum("words").alias("words"))
    runs = runs.groupBy("k", "h").agg(F.collect_list(F.struct("turn", "begin", "words")).alias("runs"))
    # The columns of df travel as one, under no name of theirs.
    marked = df.select(df[key].alias("k"), F.xxhash64(df[text]).alias("h"), F.struct(*(df[c] for c in df.columns)).alias("own"))
    first = Window.partitionBy("k", "h").orderBy("k")
    marked = marked.withColumn("row", F.row_number().over(first)).where("row = 1")
    same = marked["k"].eqNullSafe(runs["k"]) & (marked["h"] == runs["h"])
    joined = marked.join(runs, same).select("own", F.sort_array("runs").alias("runs"))
    # The text's pieces are an argument of the outer function, so a text is split once, not once for each stretch.
    split = F.split(F.col("own")[text], f"(?<={WORD[:-1]})(?={_WHITE})")

    def cut(pieces: Column) -> Column:
        return F.transform("runs", lambda x: F.array_join(F.slice(pieces, (x["begin"] + 1).cast("int"), x["words"].cast("int")), ""))

    taken = joined.select("own", F.explode(F.get(F.transform(F.array(split), cut), F.lit(0))).alias("words"))
    mixed = taken.withColumn("words", F.regexp_replace("words", f"^{_WHITE}+", ""))

    def column(name: str) -> Column:
        if name == text:
            return F.col("words").alias(name)
        if name == "n_chars":
            return F.char_length("words").cast(df.schema[name].dataType).alias(name)
        return F.col("own")[name].alias(name)

    return mixed.select(*(column(name) for name in df.columns))
