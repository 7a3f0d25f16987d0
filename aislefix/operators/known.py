"""A filter of known keys: a large side drops most rows without a partner before it is shuffled to a join.

The filter is a blocked Bloom filter kept as a table: a key's hash names a block of 4096 bits, and further hashes name
bits in it. A row meets its block by one broadcast join and tests the bits there, so it passes if its key is known, and
else in a few cases of a hundred. The inner join that follows decides; the filter never changes a result.

The table is broadcast only where the stated number of keys bounds its size; with more keys there is no filter, and
the join stays as it is. Rows with a null in a key pass no filter, as they meet no partner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_WORDS = 64
_BITS = 64 * _WORDS


@dataclass(frozen=True)
class KnownSettings:
    bits_per_key: int = 12
    hashes: int = 3
    #: Fewer keys are a table that Spark broadcasts to the join itself.
    least_keys: int = 1 << 18
    #: Bytes of the bits of a filter that may be broadcast.
    most_bytes: int = 32 << 20
    #: From this many keys on, access points that few shops know are met without asking pair by pair.
    direct_from: int = 1 << 12
    #: Pairs that one task folds with their matches.
    pairs_per_task: int = 1 << 17
    #: Shops whose columns, some 200 bytes each, are broadcast to the pairs; of more, they go with the pairs through their shuffles.
    most_shops: int = 1 << 19


DEFAULTS = KnownSettings()


@dataclass(frozen=True)
class KnownKeys:
    """``table`` has ``_block`` and ``_words``, one row a block."""

    table: DataFrame
    blocks: int
    on: tuple[str, ...]
    hashes: int

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key may be known."""
        placed = df.withColumn("_block", _block(self.on, self.blocks))
        met = placed.join(F.broadcast(self.table), "_block")
        hit = F.lit(True)
        for k in range(self.hashes):
            word, bit = _place(self.on, k)
            hit = hit & (F.get("_words", word).bitwiseAND(bit) != 0)
        return met.where(hit).select(*df.columns)


def _block(on: Sequence[str], blocks: int) -> Column:
    return F.when(_whole(on), F.pmod(F.xxhash64(*on), F.lit(blocks)))


def _whole(on: Sequence[str]) -> Column:
    found = F.lit(True)
    for name in on:
        found = found & F.col(name).isNotNull()
    return found


def _place(on: Sequence[str], turn: int) -> tuple[Column, Column]:
    """The word of the block, and the bit in it, that hash number ``turn`` sets."""
    at = F.pmod(F.xxhash64(*on, F.lit(turn + 1)), F.lit(_BITS)).cast("int")
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)))


def known_keys(keys: DataFrame, on: Sequence[str], settings: KnownSettings = DEFAULTS) -> KnownKeys | None:
    """A filter of the keys of ``keys``, or None where there are too few or too many of them.

    ``keys`` is read twice: give it a stored table. Repeated keys count as often as they occur.
    """
    count = keys.count()
    blocks = -(-count * settings.bits_per_key // _BITS)
    if count < settings.least_keys or not count or blocks * _BITS // 8 > settings.most_bytes:
        return None
    marks = F.array(*(F.struct(word.alias("w"), bit.alias("bit")) for word, bit in (_place(on, k) for k in range(settings.hashes))))
    marked = keys.where(_whole(on)).select(_block(on, blocks).alias("_block"), F.inline(marks))
    # Every block has all of its words, so that a word is found by its place.
    spark = keys.sparkSession
    blank = spark.range(blocks).select(F.col("id").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(_WORDS - 1))).alias("w"))
    blank = blank.withColumn("bit", F.lit(0).cast("bigint"))
    dealt = marked.unionByName(blank).repartition("_block")
    words = dealt.groupBy("_block", "w").agg(F.bit_or("bit").alias("bits"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"])
    return KnownKeys(words.groupBy("_block").agg(listed.alias("_words")), blocks, tuple(on), settings.hashes)
