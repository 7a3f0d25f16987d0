"""Hard negatives by slot-decomposed selection.

Anchors are a stated set of rows. An anchor's positives are the rows of its label
that score highest with it; a positive of score s admits negatives (rows of other
labels) whose score lies between ``low`` and ``high`` percent of s, and the best of them are wanted.

The windows of one anchor overlap. Their upper limits, in descending order, cut
the scores into disjoint slots: a score is in the slot of the smallest limit
that is not below it. Every task keeps the best ``negatives`` rows of each slot of each
anchor, and so does the step before and after the shuffle. As all of a slot is above all
of the next, the best under a limit are the first of its slot followed by the
best under the next limit: one pass over the slots from the last to the first
answers every window. The lower limit then cuts off the end of that list.

Scores are exact inner products of floor(scale * x). Rows are read in chunks;
against each chunk a task streams the anchors, in blocks, from the table in the shared
folder where they were written. No table is held whole anywhere, and nothing but
the kept rows is shuffled. Higher scores come first, equal ones by smaller id.

Defined results: a row with a null id, label or vector, or a null or non-finite
component, takes no part. Vectors of different lengths are compared as if the
shorter one ended in zeros. If an anchor's id is repeated, the smallest (label,
vector) is the anchor, and no row with that id is its positive or negative; other
repeated rows count each. A score beyond a bigint fails the job. A negative
positive's window is empty. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislefix.llm.files import place
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import shared_folder

_CHUNK_ROWS = 1 << 15
_CHUNK_BYTES = 32 << 20
#: Scores a task holds at once.
_SCORES = 1 << 23
#: Below this, sums of products of integers are exact in doubles.
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class MiningSettings:
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def _matrix(column: pa.Array, scale: float = 1.0) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if scale != 1.0:
        values = np.floor(scale * values)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    result = np.zeros((len(sizes), width))
    result[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return result


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer-valued matrices: a row for each of ``a``, a column for each of ``b``."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width)
    if largest < _EXACT:
        return a @ b.T
    whole = [[int(x) for x in row] for row in b.tolist()]
    return np.array([[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in whole] for row in a.tolist()], np.int64)


def best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, in descending order; equal scores by place."""
    some = np.arange(len(scores))
    if len(scores) > count:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return some[np.argsort(-scores[some], kind="stable")[:count]]


def _chunks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of some rows at a time, in order of their ids."""
    held: list[pa.RecordBatch] = []

    def merged():
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = _matrix(table.column(2).combine_chunks(), scale)
        return ids[order], table.column(1).to_numpy()[order], vectors[order]

    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK_ROWS):
            held.append(batch.slice(at, _CHUNK_ROWS))
            if sum(x.num_rows for x in held) >= _CHUNK_ROWS or sum(x.nbytes for x in held) >= _CHUNK_BYTES:
                yield merged()
                held = []
    if held:
        yield merged()


def _anchor_blocks(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    system, path = place(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=rows)


#: From (ids, labels, scores with one anchor, the anchor's row) to lists of slots, ids and scores.
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray, dict], tuple[list, list, list]]


def _against_anchors(rows: DataFrame, folder: str, pick: Pick, settings: MiningSettings) -> DataFrame:
    """(anchor_id, slot, other_id, score) of what ``pick`` keeps of every chunk for every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _chunks(batches, settings.scale):
            for block in _anchor_blocks(folder, max(1, _SCORES // max(1, len(ids)))):
                scores = inner_products(_matrix(block.column("vector"), settings.scale), vectors)
                found: list[list] = [[], [], [], []]
                for anchor, row in zip(block.drop_columns(["vector"]).to_pylist(), scores, strict=True):
                    slots, others, values = pick(ids, labels, row, anchor)
                    for column, more in zip(found, ([anchor["anchor_id"]] * len(slots), slots, others, values), strict=True):
                        column += more
                if found[0]:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=names)

    names = ["anchor_id", "slot", "other_id", "score"]
    return rows.mapInArrow(run, "anchor_id bigint, slot int, other_id bigint, score bigint")


def _first_per(found: DataFrame, count: int, *group: str) -> DataFrame:
    """The best ``count`` rows of each group; Spark limits groups before the shuffle too."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    settings: MiningSettings | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``df``'s columns.
    """
    s = settings or MiningSettings()
    sound = ~F.exists(df[vector], lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.where(df[id].isNotNull() & df[label].isNotNull() & df[vector].isNotNull() & sound).select(
        df[id].cast("bigint").alias("id"),
        df[label].cast("bigint").alias("label"),
        df[vector].cast("array<double>").alias("vector"),
        is_anchor.alias("is_anchor"),
    )
    everyone = rows.select("id", "label", "vector")
    named = rows.where("is_anchor").groupBy(F.col("id").alias("anchor_id")).agg(F.min(F.struct("label", "vector")).alias("own"))
    anchors, folder = _stored(named.select("anchor_id", "own.label", "own.vector"), "anchors")

    def alike(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, anchor: dict) -> tuple[list, list, list]:
        same = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["anchor_id"]))
        kept = same[best(scores[same], s.positives)]
        return [0] * len(kept), ids[kept].tolist(), [int(x) for x in scores[kept].tolist()]

    positives = _first_per(_against_anchors(everyone, folder, alike, s), s.positives, "anchor_id")

    # Percentages of s in two parts, so that no product leaves a bigint.
    def limit(percent: int, up: int) -> Column:
        return F.expr(f"(score div 100) * {percent} + ((score % 100) * {percent} + {up}) div 100")

    windows = positives.where("score >= 0").select(
        "anchor_id",
        F.struct((-limit(s.high, 0)).alias("negated"), "place", limit(s.high, 0).alias("most"), limit(s.low, 99).alias("least"),
                 F.col("other_id").alias("positive_id"), "score").alias("window"),
    )
    by_anchor = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    edged = anchors.join(by_anchor, "anchor_id").select("anchor_id", "label", "vector", "windows")
    asked, folder2 = _stored(edged, "anchors-with-windows")

    def unlike(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, anchor: dict) -> tuple[list, list, list]:
        limits = np.array([w["most"] for w in anchor["windows"]], scores.dtype)
        inside = (labels != anchor["label"]) & (ids != anchor["anchor_id"])
        inside &= (scores <= limits[0]) & (scores >= min(w["least"] for w in anchor["windows"]))
        places = np.flatnonzero(inside)
        places = places[np.argsort(-scores[places], kind="stable")]
        begins = np.searchsorted(-scores[places], -limits, side="left").tolist()
        slots, kept = [], []
        for slot, (begin, end) in enumerate(zip(begins, [*begins[1:], len(places)], strict=True)):
            some = places[begin : min(end, begin + s.negatives)]
            slots += [slot] * len(some)
            kept.append(some)
        kept = np.concatenate(kept)
        return slots, ids[kept].tolist(), [int(x) for x in scores[kept].tolist()]

    negatives = _first_per(_against_anchors(everyone, folder2, unlike, s), s.negatives, "anchor_id", "slot")
    entry = F.struct("place", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    in_slots = negatives.groupBy("anchor_id").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("slot") == j, entry))).alias(f"slot{j}") for j in range(s.positives))
    )
    # From the last slot to the first: the best under each limit.
    under = {s.positives - 1: F.col(f"slot{s.positives - 1}")}
    for j in reversed(range(s.positives - 1)):
        under[j] = F.slice(F.concat(F.col(f"slot{j}"), under[j + 1]), 1, s.negatives)
    answers = in_slots.select("anchor_id", F.array(*(under[j] for j in range(s.positives))).alias("under"))
    each = spread_join(asked.select("anchor_id", "windows"), answers, "anchor_id").select(
        "anchor_id", "under", F.posexplode("windows").alias("slot", "window")
    )
    admitted = F.filter(F.get("under", F.col("slot")), lambda x: x["negative_score"] >= F.col("window.least"))
    return each.select("anchor_id", "window", F.posexplode(admitted).alias("at", "negative")).select(
        "anchor_id",
        F.col("window.positive_id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("negative.negative_id").alias("negative_id"),
        F.col("window.score").alias("positive_score"),
        F.col("negative.negative_score").alias("negative_score"),
    )
