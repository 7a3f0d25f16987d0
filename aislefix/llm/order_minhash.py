"""Order MinHash: fingerprints of texts that feel the order of their parts, as edit distance does.

The parts are the k-mers of code points, each with the number of its earlier
occurrences. For each of ``slots`` hash functions the ``keep`` parts with the smallest
values are selected, put back in text order, and hashed as one tuple. Two
texts agree in a slot if they share those parts in the same order; the share of equal
slots is their likeness.

A slot's smallest parts are found without sorting: values over a bound that
leaves some dozens are dropped first, and only if too few are left is the
whole row searched.

Defined results: a null text is an empty one; a text shorter than a k-mer is its
only part; fewer parts than ``keep`` are all selected; the empty text has the
fingerprint of no part, equal to that of other empty texts; a single document
is its own next one. Rows that repeat an id follow each other by a hash of
their text. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from aislefix.llm import ordered

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TUPLE = np.uint64(0x94D049BB133111EB)
_BLOCK = 1 << 20


@dataclass(frozen=True)
class SketchSettings:
    kmer: int = 8
    keep: int = 2
    slots: int = 32


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * _TUPLE
    return values ^ (values >> np.uint64(31))


def parts_of(points: np.ndarray, kmer: int) -> np.ndarray:
    """A 64-bit hash of each k-mer with its occurrence number, in text order."""
    if not len(points):
        return np.zeros(0, np.uint64)
    points = points.astype(np.uint64) + np.uint64(1)
    count = max(1, len(points) - kmer + 1)
    rolled = np.zeros(count, np.uint64)
    for i in range(min(kmer, len(points))):
        rolled = rolled * _BASE + points[i : i + count]
    rolled = _mixed(rolled)
    ranked = np.sort(rolled)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(again):
        # Number the occurrences among the k-mers that occur more than once; the first keeps its hash.
        kinds = np.unique(again)
        at = np.minimum(np.searchsorted(kinds, rolled), len(kinds) - 1)
        places = np.flatnonzero(kinds[at] == rolled)
        order = np.argsort(at[places], kind="stable")
        grouped = at[places][order]
        count = np.arange(len(grouped))
        starts = np.concatenate([[True], grouped[1:] != grouped[:-1]])
        number = count - np.maximum.accumulate(np.where(starts, count, 0))
        later = number > 0
        places = places[order][later]
        rolled[places] = _mixed(rolled[places] + number[later].astype(np.uint64) * _BASE)
    return rolled


def _multipliers(slots: int) -> np.ndarray:
    return _mixed(np.arange(1, slots + 1, dtype=np.uint64) * _BASE) >> np.uint64(32) | np.uint64(1)


def _selected(parts: np.ndarray, multipliers: np.ndarray, keep: int) -> np.ndarray:
    """For each slot the places of its smallest values, in text order."""
    count = len(parts)
    low = (parts >> np.uint64(32)).astype(np.uint32) ^ parts.astype(np.uint32)
    chosen = np.empty((len(multipliers), keep), np.int64)
    rows = max(1, _BLOCK // count)
    # Some 4 + 4 * keep of the values of a slot are expected up to the bound.
    bound = np.uint32(min(2**32 - 1, (4 + 4 * keep) * 2**32 // count))
    for first in range(0, len(multipliers), rows):
        some = multipliers[first : first + rows].astype(np.uint32)[:, None]
        values = low[None, :] * some
        near = np.flatnonzero(values.ravel() <= bound)
        slot = near // count
        # Equal values go to the earlier place.
        near = near[np.argsort((slot << 32) | values.ravel()[near], kind="stable")]
        edges = np.searchsorted(slot, np.arange(len(some) + 1))
        full = np.diff(edges) >= keep
        best = near[edges[:-1][full][:, None] + np.arange(keep)] % count
        chosen[first : first + len(some)][full] = np.sort(best, axis=1)
        for i in np.flatnonzero(~full):
            chosen[first + i] = np.sort(np.argsort(values[i], kind="stable")[:keep])
    return chosen


def sketch(points: np.ndarray, settings: SketchSettings, multipliers: np.ndarray) -> np.ndarray:
    """One 32-bit value a slot."""
    parts = parts_of(points, settings.kmer)
    if len(parts) <= settings.keep:
        slots = _mixed(multipliers + _fold(parts[None, :]))
    else:
        slots = _mixed(multipliers + _fold(parts[_selected(parts, multipliers, settings.keep)]))
    return (slots >> np.uint64(32)).astype(">u4")


def _fold(parts: np.ndarray) -> np.ndarray:
    """Hash of each row of parts, in order."""
    value = np.zeros(len(parts), np.uint64)
    for i in range(parts.shape[1]):
        value = _mixed(value * _BASE + parts[:, i] + np.uint64(1))
    return value


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


SCHEMA = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_with_edits(
    df: DataFrame, key: str = "doc_id", text: str = "text", settings: SketchSettings | None = None
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; the next document is that of the next smaller key.

    Texts are shuffled once, in ranges of the key. Every range also gets the
    first row of the range below it, so that its own last row has a next one.
    """
    settings = settings or SketchSettings()
    docs = df.select(df[key].alias("k"), df[text].alias("t"))
    ranges = ordered.range_count(df)
    bounds = ordered.key_bounds(docs, "k", ranges)
    placed = docs.withColumn("r", ordered.range_of(F.col("k"), bounds)).withColumn("h", F.xxhash64("t"))
    # The first row of each range has its greatest key; null keys lie in range 0 and come last in it.
    first = {row.r: row.k for row in placed.groupBy("r").agg(F.max("k").alias("k")).collect()}  # one row a range
    filled = sorted(first)
    kind = df.schema[key].dataType.simpleString()
    goals = df.sparkSession.createDataFrame(
        [(r, first[filled[i - 1]]) for i, r in enumerate(filled)], f"r int, k {kind}"
    )
    # As many rows as there are ranges, so safe to broadcast; of repeated keys the smallest hash is first.
    after = (
        placed.drop("r").join(F.broadcast(goals), placed["k"].eqNullSafe(goals["k"]))
        .groupBy(goals["r"]).agg(F.min(F.struct(placed["h"], placed["t"], placed["k"])).alias("m"))
        .select("r", "m.k", "m.t", "m.h")
    )
    both = placed.select("r", "k", "t", "h", F.lit(0).alias("edge")).unionByName(after.withColumn("edge", F.lit(1)))
    dealt = both.repartitionById(ranges, F.col("r").cast("int")).sortWithinPartitions(
        "edge", F.desc_nulls_last("k"), "h"
    )
    return dealt.select("k", "t", "edge").mapInArrow(_pairs(settings, key), f"`{key}` {kind}, {SCHEMA}")


def _pairs(settings: SketchSettings, key: str):
    names = [key, *(x.strip().split()[0] for x in SCHEMA.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(settings.slots)
        held = None
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            texts = pc.fill_null(batch.column(1), "")
            for k, t, edge in zip(batch.column(0), texts, batch.column(2).to_pylist(), strict=True):
                t = t.as_py()
                own = sketch(_points(t), settings, multipliers)
                if held is not None:
                    before_key, before, before_sketch = held
                    changed = edited(before, t)
                    changed_sketch = sketch(_points(changed), settings, multipliers)
                    row = (
                        before_key, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        before_sketch.tobytes().hex(), changed_sketch.tobytes().hex(),
                        likeness(before_sketch, changed_sketch), likeness(before_sketch, own),
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                held = None if edge else (k.as_py(), t, own)
            if columns[0]:
                kinds = [batch.column(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
