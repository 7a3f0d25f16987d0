"""Packing documents into few sequences by a linear grouping scheme.

A document is cut only if it is longer than the window: into pieces as long as
the window, of which the first may be shorter. What is to be packed is then
told by how many pieces there are of each length, a table with at most as many rows
as the window has ids, whatever the corpus. The driver works out the packing on that table alone:

1. Large lengths (over ``1 / large`` of the window) are sorted and split into
   ``groups`` groups of equal cardinality; each is rounded up to the longest of its group.
2. The few sizes are packed by whole copies of configurations (sizes that fit into a
   window together), optimised by a linear program; its configurations are
   generated as they are needed, by a knapsack over its prices.
3. Actual lengths take the places of the rounded ones, so sequences gain room.
4. What is left of the large ones and all small ones go, longest first, where
   the least room is left (best fit); a new sequence is begun where none has room.

All steps work on runs of like sequences, so the plan stays some thousand numbers.
On the executors a piece learns its number among the pieces of its length, from its
place in its task and a prefix sum over the tasks, and with it finds its
sequence and offset in the plan. Ids are stored where they were encoded and are not shuffled.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null key is kept; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from aislefix.llm.cells import text_slices
from aislefix.llm.encoding import encoder
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import materialize

END_ID = 2
_SLICE_BYTES = 4 << 20
#: Rounds of the simplex method; it then goes on with what it has.
_MOST_ROUNDS = 5000
#: A run of like sequences: how many there are, and the lengths in each with their number.
Run = tuple[int, tuple[tuple[int, int], ...]]


@dataclass(frozen=True)
class BestFitSettings:
    window: int = 1024
    groups: int = 128
    large: int = 5
    #: How far the linear program may end from its optimum, as a share.
    gap: float = 5e-4


def cut_lengths(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with so many tokens: document, number in it, start, length."""
    count = np.maximum(1, -(-tokens // window))
    document = np.repeat(np.arange(len(tokens)), count)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    first = tokens - (count - 1) * window
    start = np.where(piece == 0, 0, first[document] + (piece - 1) * window)
    return document, piece, start, np.where(piece == 0, first[document], window)


def cut_documents(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, settings: BestFitSettings | None = None
) -> DataFrame:
    """The pieces of every document, stored: key, piece, start, length, ids (unsigned little-endian
    32-bit integers), and ``task`` and ``nth``, which number the pieces of a length."""
    s = settings or BestFitSettings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(s.window + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in text_slices(batch.column(1), _SLICE_BYTES):
                ids, offsets = encoder(tokenizer).encode(part, end_id)
                document, piece, start, length = cut_lengths(np.diff(offsets), s.window)
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(length), np.int64)
                sizes = np.bincount(length, minlength=s.window + 1)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes - seen, sizes)
                seen += sizes
                bounds = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32 if len(ids) < 1 << 29 else np.int64)
                kind = pa.binary() if bounds.dtype == np.int32 else pa.large_binary()
                raw = pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(document + part.first_row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), raw.cast(pa.binary()), pa.array(np.full(len(length), task)), pa.array(nth)], names=names)

    names = [key, "piece", "start", "length", "ids", "task", "nth"]
    kind = df.schema[key].dataType.simpleString()
    pieces = df.select(df[key], df[text]).mapInArrow(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary, task bigint, nth bigint"
    )
    return materialize(pieces, "pieces")


def group_sizes(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, deque]]:
    """(length, number), ascending -> groups of equal cardinality: longest length, members as a queue, longest first."""
    total = sum(n for _, n in lengths)
    ends = [total * (g + 1) // groups for g in range(groups)]
    found: list[tuple[int, deque]] = []
    seen, at, rest = 0, 0, list(lengths)
    for end in ends:
        members: deque = deque()
        while seen < end:
            length, n = rest[at]
            taken = min(n, end - seen)
            members.appendleft((length, taken))
            seen += taken
            rest[at] = length, n - taken
            at += taken == n
        if members and found and found[-1][0] == members[0][0]:  # the same size: one group
            found[-1][1].extendleft(reversed(members))
        elif members:
            found.append((members[0][0], members))
    return found


def _knapsack(sizes: np.ndarray, prices: np.ndarray, window: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth, and its worth: the best of one length more in every round."""
    room = np.arange(window + 1)[:, None] - sizes[None, :]
    fits = room >= 0
    room = np.maximum(room, 0)
    worth = np.zeros(window + 1)
    chosen: list[np.ndarray] = []
    for _ in range(window // int(sizes.min())):
        values = np.where(fits, worth[room] + prices[None, :], 0.0)
        best = values.argmax(axis=1)
        more = values[np.arange(window + 1), best]
        better = more > worth
        if not better.any():
            break
        chosen.append(np.where(better, best, -1))
        worth = np.where(better, more, worth)
    column, left = np.zeros(len(sizes)), window
    for best in reversed(chosen):
        if best[left] >= 0:
            column[best[left]] += 1
            left -= int(sizes[best[left]])
    return float(worth[window]), column


def configurations(sizes: np.ndarray, wanted: np.ndarray, window: int, gap: float = 1e-9) -> list[tuple[float, np.ndarray]]:
    """Configurations and how often to use each (a fraction), so that every size is had as often as wanted.

    The simplex method, from configurations of one size each; a round adds the configuration that the present prices
    value most, until none is worth more than a window and ``gap`` more: then no packing needs less than 1 / (1 + gap) as many.
    """
    basis = np.diag(window // sizes).astype(float)
    inverse = _inverse(basis)
    for round_no in range(1, _MOST_ROUNDS):
        worth, column = _knapsack(sizes, inverse.sum(axis=0), window)
        if worth <= 1 + gap:
            break
        amounts, change = _times(inverse, wanted), _times(inverse, column)
        steps = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(steps.argmin())
        basis[:, out] = column
        # The new column in place of the old one; rounding errors are cleared now and then.
        pivot = inverse[out] / change[out]
        inverse -= change[:, None] * pivot[None, :]
        inverse[out] = pivot
        if round_no % 50 == 0:
            inverse = _inverse(basis)
    amounts = _times(_inverse(basis), wanted)
    return [(float(x), basis[:, j].round().astype(int)) for j, x in enumerate(amounts)]


# Elementwise, as threads of a linear algebra library may hang in a driver that has started a JVM.
def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector[None, :]).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, with the largest pivot of each column."""
    size = len(matrix)
    both = np.hstack([matrix, np.eye(size)])
    for k in range(size):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= rest[:, None] * both[k][None, :]
    return both[:, size:]


def _take(queue: deque, count: int) -> list[tuple[int, int]]:
    """The next ``count`` lengths of a queue, as (length, number)."""
    taken = []
    while count:
        length, n = queue.popleft()
        some = min(n, count)
        taken.append((length, some))
        if n > some:
            queue.appendleft((length, n - some))
        count -= some
    return taken


def _side_by_side(slots: list[list[tuple[int, int]]], copies: int) -> Iterator[Run]:
    """Slots of ``copies`` sequences, each a list of (length, number): runs of sequences that hold the same lengths."""
    ends = sorted({int(e) for slot in slots for e in np.cumsum([n for _, n in slot])})
    at, before = [0] * len(slots), 0
    used = [0] * len(slots)
    for end in ends:
        held: dict[int, int] = {}
        for k, slot in enumerate(slots):
            length, n = slot[at[k]]
            held[length] = held.get(length, 0) + 1
            used[k] += end - before
            if used[k] == n:
                at[k], used[k] = at[k] + 1, 0
        yield end - before, tuple(sorted(held.items(), reverse=True))
        before = end
    assert before == copies


def plan_packing(counts: dict[int, int], settings: BestFitSettings | None = None) -> list[Run]:
    """Runs of sequences that together hold every length as often as counted."""
    s = settings or BestFitSettings()
    runs: list[Run] = []
    rest: dict[int, int] = {length: n for length, n in counts.items() if n and length <= s.window // s.large}
    whole = counts.get(s.window, 0)
    if whole:
        runs.append((whole, ((s.window, 1),)))
    large = sorted((length, n) for length, n in counts.items() if n and s.window // s.large < length < s.window)
    # Room left -> runs of sequences with it.
    room: list[list[Run]] = [[] for _ in range(s.window + 1)]
    if large:
        grouped = group_sizes(large, s.groups)
        sizes = np.array([size for size, _ in grouped])
        wanted = np.array([sum(n for _, n in members) for _, members in grouped])
        for amount, column in sorted(configurations(sizes, wanted, s.window, s.gap), key=lambda x: -x[0]):
            left = [sum(n for _, n in members) for _, members in grouped]
            copies = min([int(amount + 1e-6), *(left[j] // column[j] for j in np.flatnonzero(column))])
            if copies <= 0:
                continue
            slots = [_take(grouped[j][1], copies) for j in np.flatnonzero(column) for _ in range(column[j])]
            for number, held in _side_by_side(slots, copies):
                room[s.window - sum(length * n for length, n in held)].append((number, held))
        for _, members in grouped:
            for length, n in members:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        _best_fit(room, length, rest[length], s.window)
    return runs + [run for same in room for run in same]


def _best_fit(room: list[list[Run]], length: int, number: int, window: int) -> None:
    """Put pieces of one length where the least room is left. The room that suffices and is least
    stays so until no piece fits in any more, so like sequences are filled together."""
    least = length
    while number:
        while least <= window and not room[least]:
            least += 1
        if least > window:
            least, (sequences, held) = window, (-(-number // (window // length)), ())
        else:
            sequences, held = room[least].pop()
        each = min(least // length, number)
        filled = min(sequences, number // each)
        room[least - each * length].append((filled, _with(held, length, each)))
        if sequences > filled and (held or least < window):
            room[least].append((sequences - filled, held))
        number -= filled * each


def _with(held: tuple[tuple[int, int], ...], length: int, number: int) -> tuple[tuple[int, int], ...]:
    known = dict(held)
    known[length] = known.get(length, 0) + number
    return tuple(sorted(known.items(), reverse=True))


def place_pieces(pieces: DataFrame, settings: BestFitSettings | None = None) -> DataFrame:
    """Pieces, as ``cut_documents`` numbers them, with ``sequence_id`` and ``offset``; other columns are carried along."""
    s = settings or BestFitSettings()
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most one row for each length of the window.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table: dict[int, list[list[int]]] = {}
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for sequences, held in plan_packing(counts, s):
        offset = 0
        for length, each in held:
            table.setdefault(length, []).append([used[length], sequence, each, offset])
            used[length] += sequences * each
            offset += length * each
        sequence += sequences
    if used != counts:
        raise RuntimeError("the plan does not hold every piece once")
    rows = [(length, *map(list, zip(*runs, strict=True))) for length, runs in table.items()]
    schema = "length bigint, begins array<bigint>, sequences array<bigint>, each array<bigint>, offsets array<bigint>"
    plan = spark.createDataFrame(rows, schema)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = spread_join(bases, plan, "length")
    carried = F.struct(*(F.col(f"`{name}`") for name in pieces.columns if name not in ("task", "nth"))).alias("own")
    narrow = pieces.select(carried, "length", "task", "nth")
    numbered = spread_join(narrow, found, ["length", "task"]).withColumn("number", F.col("base") + F.col("nth"))
    run = F.size(F.filter("begins", lambda begin: begin <= F.col("number"))) - 1
    inside = numbered.withColumn("run", run).withColumn("inside", F.col("number") - F.get("begins", F.col("run")))
    each = F.get("each", F.col("run"))
    return inside.select(
        "own.*",
        (F.get("sequences", F.col("run")) + F.floor((F.col("inside") - F.col("inside") % each) / each)).alias("sequence_id"),
        (F.get("offsets", F.col("run")) + (F.col("inside") % each) * F.col("length")).alias("offset"),
    )


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence, from placed pieces that still carry theirs."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_best_fit(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", settings: BestFitSettings | None = None) -> DataFrame:
    """key, piece, start, length, ids, sequence_id, offset of every piece."""
    return place_pieces(cut_documents(df, tokenizer, key, text, settings=settings), settings)
