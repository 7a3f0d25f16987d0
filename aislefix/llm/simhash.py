"""SimHash near-duplicates, found through anchor points.

Fingerprint: XXH64 (seed 42) of every three-word shingle; a bit is 1 if it is
set in over half of the hashes. Two fingerprints are linked if they differ in
at most ``most_bits`` (0 to 2) bits; documents of one component are one group.

Anchors: the words of the Hamming code of length 63 and one free bit (bit 0).
Every 64-bit value is within 1 bit of an anchor (covering radius 1). Two values
at most 2 bits apart have a value in between that is at most 1 bit from either,
and the anchor of that value is within 1 + 1 bits of both. So each distinct
fingerprint is replicated to every anchor within the covering radius plus its
own half of the threshold, at most 33 anchors, and linked pairs always meet.
(Were only one side replicated, the radius would have to be 1 + 2, with some
650 anchors; the pairs found are the same.) The anchors around a value come from
its syndrome by arithmetic; no list of anchors exists.

At one anchor there are at most 2081 distinct fingerprints, those within 2 bits
of it, whatever the size of the corpus; they are compared there, and only a
spanning tree of what is linked leaves the task.

Defined results: a null text, or one without words, has fingerprint zero and is
linked like any other; one or two words are one shingle; repeated rows and
equal texts share a fingerprint; a null id counts as an id smaller than none, so
a group of null ids alone has a null component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislefix.llm.cells import TextSlice, release_memory, text_slices, word_spans
from aislefix.llm.components import components
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import materialize

SEED = 42
SHINGLE = 3
_POSITIONS = 63
_SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(part: TextSlice) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit integers."""
    result = np.zeros(part.rows, np.int64)
    starts, ends, first = word_spans(part.data, part.offsets)
    if not len(starts):
        return result
    # The words of the slice, each followed by one space.
    lengths = ends - starts
    wide = np.concatenate([[0], np.cumsum(lengths + 1)])
    source = np.arange(wide[-1]) + np.repeat(starts - wide[:-1], lengths + 1)
    spaced = _LOWER[part.data[np.minimum(source, len(part.data) - 1)]]
    spaced[wide[1:] - 1] = 32
    joined = spaced.tobytes()
    counts = np.diff(first)
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(part.rows), shingles)
    base = np.concatenate([[0], np.cumsum(shingles)])
    head = np.arange(base[-1]) - np.repeat(base[:-1], shingles) + np.repeat(first[:-1], shingles)
    last = np.minimum(head + SHINGLE, first[owner + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(wide[head].tolist(), (wide[last] - 1).tolist(), strict=True)),
        np.uint64, len(head),
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    some = shingles > 0
    ones = np.add.reduceat(bits, base[:-1][some], axis=0, dtype=np.int32)
    majority = np.packbits(2 * ones > shingles[some][:, None], axis=1)
    result[some] = np.ascontiguousarray(majority).view(np.int64).ravel()
    return result


def with_fingerprint(
    df: DataFrame, key: str = "doc_id", text: str = "text", carried: tuple[str, ...] | list[str] = ()
) -> DataFrame:
    """``key``, the ``carried`` columns and ``fp`` (bigint, the 64 bits) of every row."""
    names = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([fingerprints_of(p) for p in text_slices(batch.column(0), _SLICE_BYTES)])
                kept = [batch.column(i + 1) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*names, "fp"])
            batch = found = kept = None
        release_memory()

    kinds = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)
    return df.select(df[text], *(df[name] for name in names)).mapInArrow(run, f"{kinds}, fp bigint")


def _syndrome(fp: Column) -> Column:
    """Exclusive or of the positions 1 to 63 of the set bits; zero for the words of the code."""
    total = F.lit(0)
    for bit in range(6):
        mask = sum(1 << p for p in range(1, _POSITIONS + 1) if p >> bit & 1)
        mask -= (mask >> 63) << 64
        total = total + (F.bit_count(fp.bitwiseAND(F.lit(mask).cast("bigint"))) % 2) * (1 << bit)
    return total


def at_anchors(values: DataFrame) -> DataFrame:
    """``anchor, fp`` for every anchor within 2 bits of each ``fp``."""
    marked = values.select("fp", _syndrome(F.col("fp")).cast("int").alias("s"))
    pairs = f"""transform(filter(sequence(1, {_POSITIONS}), p -> (p ^ s) > p),
                          p -> fp ^ shiftleft(1L, p) ^ shiftleft(1L, p ^ s))"""
    near = f"""CASE WHEN s = 0 THEN array(fp, fp ^ 1L)
                    ELSE concat(array(fp ^ shiftleft(1L, s), fp ^ shiftleft(1L, s) ^ 1L), {pairs}) END"""
    return marked.select(F.explode(F.expr(near)).alias("anchor"), "fp")


def _trees(values: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct values met at one anchor."""
    values = np.unique(values)
    left, links = np.arange(1, len(values)), []
    # Grow one tree at a time: from each reached value to the unreached ones near it.
    queue = [0]
    while queue or len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        apart = np.bitwise_count((values[left] ^ values[at]).view(np.uint64))
        near = left[apart <= most_bits]
        left = left[apart > most_bits]
        links += [(int(values[at]), int(values[x])) for x in near]
        queue += near.tolist()
    return links


def _links_at(anchors: np.ndarray, values: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1], [True]]))
    sizes, links = np.diff(edges), []
    for i in np.flatnonzero(sizes > 1):
        links += _trees(values[edges[i] : edges[i + 1]], most_bits)
    return links


def links_between(values: DataFrame, most_bits: int = 2) -> DataFrame:
    """Links ``a, b`` that connect what is connected among distinct ``fp`` values."""
    if not 0 <= most_bits <= 2:
        raise ValueError("anchors within 2 bits find fingerprints at most 2 bits apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchors = np.concatenate([held_a, batch.column(0).to_numpy()])
            found = np.concatenate([held_v, batch.column(1).to_numpy()])
            if not len(anchors):
                continue
            # The last anchor of a batch may go on in the next; it has 2081 rows at most.
            cut = int(np.searchsorted(anchors, anchors[-1]))
            held_a, held_v = anchors[cut:], found[cut:]
            yield _link_batch(_links_at(anchors[:cut], found[:cut], most_bits) if cut else [])
        if len(held_a):
            yield _link_batch(_links_at(held_a, held_v, most_bits))
        release_memory()

    met = at_anchors(values).repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _rooted(marked: DataFrame, most_bits: int) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of ``marked``: its group, and the group's smallest ``_key``."""
    kinds = materialize(marked.groupBy("fp").agg(F.min("_key").alias("least")), "kinds")
    roots = components(links_between(kinds.select("fp"), most_bits))
    placed = spread_join(kinds, roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(placed, groups, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = 2) -> DataFrame:
    """``key, fingerprint, component_id`` of every row; component_id is the smallest key of its group."""
    marked = materialize(with_fingerprint(df, key, text).withColumnRenamed(key, "_key"), "fingerprints")
    named = _rooted(marked, most_bits).select("fp", "component_id")
    found = spread_join(marked, named, "fp")
    return found.select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = 2) -> DataFrame:
    """One row of each group, that with the smallest key, with all columns of ``df``.

    Of a group's rows that share its smallest key, that with the smallest hash of the text stays, so a key
    whose texts are in different groups stays once for each. Rows without a key have no group to be named
    by; they are kept.
    """
    keyed = df.where(df[key].isNotNull()).select(df[key].alias("_key"), df[text].alias("_text"))
    marked = with_fingerprint(keyed.select("*", F.xxhash64("_text").alias("_hash")), "_key", "_text", carried=["_hash"])
    marked = materialize(marked, "fingerprints")
    rooted = _rooted(marked, most_bits)
    first = spread_join(marked, rooted, "fp").where("_key = component_id").groupBy("root").agg(
        F.first("_key").alias("_chosen"), F.min("_hash").alias("_chosen_hash")
    )
    chosen = first.select("_chosen", "_chosen_hash")
    same = (df[key] == chosen["_chosen"]) & (F.xxhash64(df[text]) == chosen["_chosen_hash"])
    stays = df.join(chosen, same, "left_semi")
    return _first_of_text(stays, key, text).unionByName(df.where(df[key].isNull()))


def _first_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """One of the rows that repeat both key and text."""
    by_text = Window.partitionBy("key", "hash").orderBy("hash")
    held = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("hash"), F.struct(*(df[c] for c in df.columns)).alias("own"))
    return held.withColumn("rank", F.row_number().over(by_text)).where("rank = 1").select("own.*")
