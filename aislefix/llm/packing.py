"""Packing token streams into windows by order-preserving dynamic programming.

The documents of a task form one stream of ids, in the order they are read. The
stream is cut into sequences of at most ``window`` ids. Cuts may lie at the end of
a document, at the end of a sentence, or, inside a sentence that is too long,
every ``forced_gap`` ids. Each sequence costs its padding (none if its length is a
power of two), each cut inside a document a penalty. The cheapest way to cut is
found by dynamic programming over the possible cuts: the best predecessor in the
last ``window`` ids is the front of a monotone queue, since padding is linear in the
length; predecessors at a distance of a power of two are looked up besides.

A stream of any length takes bounded memory: when some eight windows are settled
they are published, and the search goes on from the last settled cut.

Nothing is shuffled. Numbers of sequences are unique, made from the task's
number and a count. Sequences never go over the input's partitions; the last one of
a partition is cut into powers of two where that costs less than its padding.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aislefix.llm.cells import TextSlice, text_slices
from aislefix.llm.encoding import Encoder, encoder

END_ID = 1
_SLICE_BYTES = 4 << 20
_SEQUENCES_PER_TASK = 1 << 33


@dataclass(frozen=True)
class PackingSettings:
    window: int = 2048
    sentence_penalty: int = 4
    forced_penalty: int = 32
    # Sentence ends nearer than this to the one before are passed over; longer gaps get forced places.
    sentence_gap: int = 16
    forced_gap: int = 256


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Numbers of the places to cut at, from the first to the last place.

    ``places`` ascend from the start of the stream to its end, and no two
    neighbours are more than ``window`` apart. A sequence between two chosen places
    costs its padding and the penalty of its later place.
    """
    count = len(places)
    at, extra = places.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}
    power = 1
    while power <= window:
        before = np.searchsorted(places, places - power)
        hit = np.flatnonzero((before < count) & (places[np.minimum(before, count - 1)] == places - power))
        for j, i in zip(hit.tolist(), before[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        power *= 2
    cost, back = [0] * count, [0] * count
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])
    for j in range(1, count):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        best, chosen = queue[0]
        best += window - here
        for i in exact.get(j, ()):
            if cost[i] < best:
                best, chosen = cost[i], i
        cost[j], back[j] = best + extra[j], chosen
        level = cost[j] + here
        while queue and queue[-1][0] >= level:
            queue.pop()
        queue.append((level, j))
    path = [count - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


class _Stream:
    """The part of a task's stream that is not published yet."""

    def __init__(self, settings: PackingSettings, first_sequence: int):
        self.settings, self.sequence = settings, first_sequence
        self.ids = np.zeros(0, np.uint32)
        # Of each document with ids here: key, where it begins here (negative if before), its length.
        self.keys: list = []
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.soft = np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, offsets: np.ndarray, soft: np.ndarray) -> None:
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.keys += keys
        self.begins = np.concatenate([self.begins, offsets[:-1] + base])
        self.lengths = np.concatenate([self.lengths, np.diff(offsets)])
        self.soft = np.concatenate([self.soft, soft + base])

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        s, total = self.settings, len(self.ids)
        hard = np.unique(np.concatenate([[0, total], self.begins[self.begins > 0]]))
        soft = self.soft[(self.soft > 0) & (self.soft < total)]
        if len(soft):  # the first sentence end in each stretch of sentence_gap ids
            soft = soft[np.unique(soft // s.sentence_gap, return_index=True)[1]]
        soft = np.setdiff1d(soft, hard, assume_unique=True)
        marks = np.union1d(hard, soft)
        gaps = np.diff(marks)
        more = [np.arange(a + s.forced_gap, a + g, s.forced_gap) for a, g in zip(marks[:-1][gaps > s.window // 4], gaps[gaps > s.window // 4], strict=True)]
        forced = np.concatenate([*more, np.zeros(0, np.int64)]).astype(np.int64)
        places = np.concatenate([hard, soft, forced])
        penalties = np.repeat([0, s.sentence_penalty, s.forced_penalty], [len(hard), len(soft), len(forced)])
        order = np.argsort(places, kind="stable")
        return places[order], penalties[order]

    def settle(self, final: bool) -> list[pa.Array] | None:
        """Publish the sequences that are settled, or all."""
        s = self.settings
        if not len(self.ids) or not final and len(self.ids) < 32 * s.window:
            return None
        places, penalties = self._places()
        cuts = places[best_cuts(places, penalties, s.window)].tolist()
        if not final:
            cuts = cuts[: max(2, len(cuts) - 8)]
        elif (last := cuts[-1] - cuts[-2]) and padding(last, s.window) > s.forced_penalty * (last.bit_count() - 1):
            powers = [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1]
            cuts += np.cumsum([cuts[-2], *powers])[1:-1].tolist()
            cuts.sort()
        return self._publish(np.array(cuts, np.int64))

    def _publish(self, cuts: np.ndarray) -> list[pa.Array]:
        end = int(cuts[-1])
        starts = np.union1d(cuts[:-1], self.begins[(self.begins > 0) & (self.begins < end)])
        ends = np.append(starts[1:], end)
        doc = np.searchsorted(self.begins, starts, side="right") - 1
        sequence = np.searchsorted(cuts, starts, side="right") - 1
        raw = self.ids[:end].astype("<u4").tobytes()
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [
            pa.array([self.keys[d] for d in doc.tolist()]), pa.array(starts - self.begins[doc]), pa.array(ends - starts),
            pa.array(sums, pa.int64()), pa.array(self.lengths[doc]), pa.array(sequence + self.sequence),
            pa.array(starts - cuts[sequence]),
        ]
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(self.begins + self.lengths, end, side="right"))
        self.keys, self.begins, self.lengths = self.keys[keep:], self.begins[keep:] - end, self.lengths[keep:]
        self.ids, self.soft = self.ids[end:], self.soft[self.soft > end] - end
        return columns


def _sentence_ends(coder: Encoder) -> np.ndarray:
    """For each id, whether a sentence may end with it: a line break, or a mark that closes sentences."""
    ends = np.zeros(max(coder.vocabulary, END_ID + 1), dtype=bool)
    for i in range(coder.vocabulary):
        text = coder.tokenizer.decode([i], skip_special_tokens=False)
        ends[i] = "\n" in text or text.rstrip().endswith((".", "!", "?"))
    return ends


_ENDS: dict[str, np.ndarray] = {}


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", settings: PackingSettings | None = None
) -> DataFrame:
    """The pieces of every document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    settings = settings or PackingSettings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coder = encoder(tokenizer)
            if tokenizer not in _ENDS:
                _ENDS[tokenizer] = _sentence_ends(coder)
            stream = stream or _Stream(settings, TaskContext.get().partitionId() * _SEQUENCES_PER_TASK)
            kind = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for part in text_slices(batch.column(1), _SLICE_BYTES):
                yield from _one(stream, coder, part, keys, kind, _ENDS[tokenizer])
        if stream:
            columns = stream.settle(final=True)
            if columns:
                yield _batch(columns, kind)

    def _one(stream: _Stream, coder: Encoder, part: TextSlice, keys: list, kind: pa.DataType, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, offsets = coder.encode(part, END_ID)
        stream.add(keys[part.first_row : part.first_row + part.rows], ids, offsets, np.flatnonzero(ends[ids]) + 1)
        columns = stream.settle(final=False)
        if columns:
            yield _batch(columns, kind)

    def _batch(columns: list[pa.Array], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0].cast(kind), *columns[1:]], names=names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kinds}, " + ", ".join(f"`{n}` bigint" for n in names[1:]))
